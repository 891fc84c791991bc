"""Packing into length buckets of least padding, and batches of a token budget inside each bucket.

Dynamic programming over the histogram of all lengths picks the ``BUCKETS`` upper bounds that minimise the
padded total; it is exact, as the cost has the quadrangle inequality. Documents of a bucket are padded to its
bound and dealt in the order of their ids to batches of ``BUDGET // bound`` documents (one at least).

Places in a bucket come from a range partitioning by id: each part counts its own documents by bucket, and
one number for each part and bucket is added; no bucket is ever sorted or held as a whole.

Lengths are words, or a column of the table; ``query`` counts words, as its SQL does, and ``token_query`` the ids
of the tokenizer of ``token_output``, the end of the text included.

Defined cases: null and empty texts have length 0 in words; rows with one doc_id stand by length; a null doc_id stands
first; an empty table gives no rows; with fewer lengths than buckets each length is a bucket of its own;
other columns are ignored. A document over the budget is a batch by itself; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, table
from .token_output import END_ID, TOKENIZER, encode_batches

BUCKETS, BUDGET = 8, 32_768
RANKED = "part int, doc_id long, n_tokens long, bucket int, bucket_length long, nth long"


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets of ascending lengths with the least padded total.

    Of equal totals the one whose earlier buckets end first is taken.
    """
    m = len(lengths)
    total = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    best, origin = lengths * total[1:], []
    for k in range(1, min(buckets, m)):
        now, start = np.full(m, np.iinfo(np.int64).max // 2), np.full(m, -1)
        todo = [(k, m - 1, k - 1, m - 2)]  # ends, and where the bucket before may end
        while todo:
            low, high, a, b = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            last = min(b, j - 1)
            cost = best[a : last + 1] + lengths[j] * (total[j + 1] - total[a + 1 : last + 2])
            i = int(cost.argmin())
            now[j], start[j] = cost[i], a + i
            todo += [(low, j - 1, a, a + i), (j + 1, high, a + i, b)]
        best = now
        origin.append(start)
    at, out = m - 1, []
    for start in reversed(origin):
        out.append(int(lengths[at]))
        at = int(start[at])
    return [*([int(lengths[at])] if m else []), *reversed(out)]


def rank_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each bucket in this part."""
    part, seen = TaskContext.get().partitionId(), np.zeros(n, dtype=np.int64)
    for batch in batches:
        bucket = batch.column(2).to_numpy()
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=n)
        nth = np.empty(len(bucket), dtype=np.int64)
        nth[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(count) - count, count)
        nth += seen[bucket]
        seen += count
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), part, dtype=np.int32)), *batch.columns, pa.array(nth)], ["part", "doc_id", "n_tokens", "bucket", "bucket_length", "nth"])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, place) of every row of (doc_id, text).

    length: the column of lengths, not null; without one tokens are words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    sized = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words if length is None else F.col(length).cast("long")).alias("n_tokens"), F.spark_partition_id().alias("origin")))
    # A row for each length at most, however many documents.
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    ends = bounds(histogram.column("n_tokens").to_numpy(), histogram.column("n").to_numpy(), buckets) or [0]
    number, upper = F.lit(len(ends) - 1), F.lit(ends[-1])
    for k in range(len(ends) - 2, -1, -1):
        number, upper = F.when(F.col("n_tokens") <= ends[k], k).otherwise(number), F.when(F.col("n_tokens") <= ends[k], ends[k]).otherwise(upper)
    dealt = sized.select("doc_id", "n_tokens", "origin", number.cast("int").alias("bucket"), upper.cast("long").alias("bucket_length"))
    # Rows of one id, which may be very many, are told apart by length and by the part that they come from.
    sorted_parts = dealt.repartitionByRange(shuffle_width(spark), "doc_id", "n_tokens", "origin").sortWithinPartitions("doc_id", "n_tokens", "origin")
    ranked = scratch(sorted_parts.select("doc_id", "n_tokens", "bucket", "bucket_length").mapInArrow(lambda batches: rank_batches(batches, len(ends)), RANKED))
    scratch.drop(ranked)
    # A row for each part and bucket.
    sizes = ranked.groupBy("bucket", "part").agg(F.count("*").alias("n")).orderBy("bucket", "part").collect()
    before, at = [], {}
    for row in sizes:
        before.append((row["bucket"], row["part"], at.get(row["bucket"], 0)))
        at[row["bucket"]] = at.get(row["bucket"], 0) + row["n"]
    offsets = spark.createDataFrame(before, "bucket int, part int, before long")
    place = F.col("before") + F.col("nth")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    return ranked.join(offsets, ["bucket", "part"]).select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(place / room).cast("long").alias("batch"), F.pmod(place, room).alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def length_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of ids of each text."""
    for batch in encode_batches(batches, TOKENIZER, END_ID):
        yield batch.select(["doc_id", "n_tokens"])


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pack(docs.mapInArrow(length_batches, "doc_id long, n_tokens long"), length="n_tokens")


def _oracle() -> str:
    layers = ["l0 AS (SELECT j, len * cum AS cost, -1 AS i FROM s)"]
    for k in range(1, BUCKETS):
        layers.append(
            f"l{k} AS (SELECT j, cost, i FROM (SELECT s.j, p.j AS i, p.cost + s.len * (s.cum - q.cum) AS cost, row_number() OVER (PARTITION BY s.j ORDER BY p.cost + s.len * (s.cum - q.cum), p.j) AS r "
            f"FROM s JOIN l{k - 1} p ON p.j < s.j JOIN s q ON q.j = p.j) WHERE r = 1)"
        )
    ends = [f"e{BUCKETS - 1} AS (SELECT max(j) AS j FROM s)"]
    for k in range(BUCKETS - 1, 0, -1):
        ends.append(f"e{k - 1} AS (SELECT i AS j FROM l{k} WHERE j = (SELECT j FROM e{k}))")
    union = " UNION ALL ".join(f"SELECT {k} AS bucket, len AS bucket_length FROM s WHERE j = (SELECT j FROM e{k})" for k in range(BUCKETS))
    return rf"""
WITH t AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS len, count(*) AS c FROM t GROUP BY 1),
s AS MATERIALIZED (SELECT len, CAST(row_number() OVER (ORDER BY len) - 1 AS INTEGER) AS j, CAST(sum(c) OVER (ORDER BY len) AS BIGINT) AS cum FROM h),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in layers)},
{", ".join(ends)},
b AS ({union}),
d AS (SELECT doc_id, n_tokens, min(bucket) AS bucket, min(bucket_length) AS bucket_length FROM t JOIN b ON n_tokens <= bucket_length GROUP BY doc_id, n_tokens),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS n, greatest(1, {BUDGET} // greatest(bucket_length, 1)) AS room FROM d)
SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, bucket_length, CAST(n // room AS BIGINT) AS batch, CAST(n % room AS BIGINT) AS place FROM p
"""


ORACLE = _oracle()
