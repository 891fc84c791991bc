"""Benchmark decontamination by winnowing.

Of all hashes of ``GRAM`` consecutive words only the minima of every run of ``WINDOW - GRAM + 1`` hashes
are kept, on both sides. A shared span of ``WINDOW`` words holds one whole run, so both sides keep the
same hash in it: every such span is found. Items of fewer words are matched whole, by hashes of their own length.

The fingerprints of both sides are joined by hash. A fingerprint carries the hashes of the words around it, as many
as a window can reach, so a hit is extended word by word on either side without either text, and counts if the run
has ``WINDOW`` words; the runs of all fingerprints together are all words of all shared windows. Fingerprints of
documents that no item has are dropped by a sieve over the benchmark's hashes, whose size is bounded; equal
surroundings of many items are compared once; copies of a text are treated as one, by two 64-bit hashes.

Defined cases: null and empty texts have no words and no hits; an item without words is left out; a null
item id counts as the empty string; items with one id count as one; repeated documents are reported each;
empty tables give no rows or no hits; texts of any length are read whole; other columns are kept by ``decontaminate``
and ignored by ``summary``. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperledger.session import ship

from .common import ALNUM, Scratch, Words, chunks, mix, table

WINDOW, GRAM = 10, 5
#: Bits of the sieve for each hash of the benchmark, and at least and at most in all (16 MB).
BITS_A_HASH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: Bytes of a table that are sent to all executors at most; greater ones are joined by a shuffle.
SENT_BYTES = 32 << 20
FOUND = ["n_words", "begins", "ends", "items"]
HITS = "h1 long, h2 long, size int, hash long, at int, near array<long>"
PRINTS = "item string, size int, hash long, near array<long>"
_U = np.uint64


def winnow(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are the least of some run of ``window - gram + 1`` inside a row, and their first words."""
    value, at, first = words.grams(gram)
    run = window - gram + 1
    if len(value) < run:
        return value[:0], at[:0]
    low = value[: len(value) - run + 1].copy()
    for j in range(1, run):
        np.minimum(low, value[j : len(value) - run + 1 + j], out=low)
    whole = np.repeat(first[1:], np.diff(first))[: len(low)] - np.arange(len(low)) >= run
    kept = np.zeros(len(value), dtype=bool)
    for j in range(run):
        kept[j : j + len(low)] |= whole & (value[j : j + len(low)] == low)
    return value[kept], at[kept]


def fingerprints(words: Words, gram: int, window: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes, first words): winnowed grams, and, as negative sizes, all runs of the lengths of short items."""
    yield gram, *winnow(words, gram, window)
    for n in short:
        yield -n, *words.grams(n)[:2]


def surroundings(words: Words, at: np.ndarray, gram: int, window: int) -> pa.ListArray:
    """Word hashes from ``window - gram`` words before each place to as many behind its gram; null beyond the text."""
    reach = window - gram
    place = at[:, None] + np.arange(-reach, gram + reach)
    row = np.searchsorted(words.first, at, side="right") - 1
    inside = (place >= words.first[row][:, None]) & (place < words.first[row + 1][:, None])
    values = words.hash[np.where(inside, place, 0)] if len(at) else np.empty((0, gram + 2 * reach), dtype=_U)
    flat = pa.array(values.ravel().view(np.int64), mask=~inside.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (gram + 2 * reach), pa.int32()), flat)


def item_batches(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, text in chunks(batch):
            words = Words(text, ALNUM)
            row = words.row()
            short = sorted({int(x) for x in words.count if 0 < x < window})
            for size, value, at in fingerprints(words, gram, window, short):
                fits = words.count[row[at]] >= window if size > 0 else words.count[row[at]] == -size
                value, at = value[fits], at[fits]
                columns = [part.column(0).take(pa.array(row[at])), pa.array(np.full(len(at), size), pa.int32()), pa.array(value.view(np.int64)), surroundings(words, at, gram, window)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "size", "hash", "near"])


def hit_batches(batches: Iterator[pa.RecordBatch], sent, gram: int, window: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of texts that pass the sieve; of equal texts of a task those of the first."""
    sieve, short = sent.value
    mask, seen = _U(len(sieve) * 8 - 1), set()
    for batch in batches:
        for part, text in chunks(batch):
            words = Words(text, ALNUM)
            row = words.row()
            found = []
            for size, value, at in fingerprints(words, gram, window, short):
                slot = mix(value) & mask
                some = np.flatnonzero((sieve[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1)
                found.append((size, value[some], at[some]))
            hit = np.unique(row[np.concatenate([at for _, _, at in found])])
            keys = list(zip(*(part.column(k).take(pa.array(hit)).to_pylist() for k in (0, 1)), strict=True))
            fresh = np.zeros(len(text), dtype=bool)
            for i, key in zip(hit.tolist(), keys, strict=True):
                fresh[i] = key not in seen
                seen.add(key)
            for size, value, at in found:
                new = fresh[row[at]]
                value, at = value[new], at[new]
                owner = row[at]
                columns = [
                    *(part.column(k).take(pa.array(owner)) for k in (0, 1)), pa.array(np.full(len(at), size), pa.int32()), pa.array(value.view(np.int64)),
                    pa.array(at - words.first[owner], pa.int32()), surroundings(words, at, gram, window),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "size", "hash", "at", "near"])


def sieve_of(prints: DataFrame, n: int) -> np.ndarray:
    """Bits that are set where a hash of the benchmark falls, put together 64 at a time by the executors."""
    bits = LEAST_BITS
    while bits < min(BITS_A_HASH * n, MOST_BITS):
        bits *= 2
    slot = prints.select("hash").mapInArrow(lambda batches: slot_batches(batches, bits), "slot long")
    packed = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    return out.view(np.uint8)


def slot_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value = batch.column(0).to_numpy().view(_U)
        yield pa.RecordBatch.from_arrays([pa.array((mix(value) & _U(bits - 1)).astype(np.int64))], ["slot"])


def run_at(gram: int, window: int) -> tuple[Column, Column]:
    """Begin and end of the run of equal words around a hit, from the surroundings ``near`` and ``other``; null if it is no hit."""
    reach = window - gram
    same = [F.coalesce(F.get("near", F.lit(k)) == F.get("other", F.lit(k)), F.lit(False)) for k in range(gram + 2 * reach)]
    left = right = F.lit(0)
    for k in range(reach):  # from the outside inwards
        left = F.when(same[k], left + 1).otherwise(0)
        right = F.when(same[-1 - k], right + 1).otherwise(0)
    whole = F.lit(True)
    for k in range(max(gram, window - 1)):
        whole = whole & (same[reach + k] | (F.lit(k) >= F.abs("size")))
    long_enough = whole & ((F.col("size") < 0) | (left + right + gram >= window))
    begin = F.when(F.col("size") < 0, F.col("at")).otherwise(F.col("at") - left)
    end = F.when(F.col("size") < 0, F.col("at") - F.col("size")).otherwise(F.col("at") + gram + right)
    return F.when(long_enough, begin), F.when(long_enough, end)


def merged(runs: Iterator[tuple[int, int]]) -> tuple[list[int], list[int]]:
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(runs):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def size_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Adds the number of words."""
    for batch in batches:
        for part, text in chunks(batch, text_col):
            n_words = Words(text, ALNUM, hashed=False).count
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words, pa.int64())], [*part.schema.names, "n_words"])


def merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a text, each as begin and end, to runs that don't touch."""
    for batch in batches:
        out = [merged((x["begin"], x["end"]) for x in runs) for runs in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in out], pa.list_(pa.int32())) for k in (0, 1))], ["h1", "h2", "begins", "ends"])


def sendable(df: DataFrame, row_bytes: int, most: int) -> DataFrame:
    """A stored table with the hint that its measured size calls for; its rows take about so many bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df.hint("merge")


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, window: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of docs with four more columns last, named as in ``FOUND`` (with underscores where docs has
    such a name): the number of words, the spans of words that occur in benchmark windows, and the ids, sorted
    as strings, of the items that have them. Tables of more than ``sent_bytes`` aren't sent to all executors."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    prints = scratch(items.mapInArrow(lambda batches: item_batches(batches, gram, window), PRINTS))
    # Equal surroundings are one place, whichever items have them.
    place = F.xxhash64("size", "near").alias("place")
    places = scratch(prints.select("hash", "size", F.col("near").alias("other"), place).dropDuplicates(["place"]))
    short = sorted(-r["size"] for r in places.select("size").distinct().collect() if r["size"] < 0)  # under the window
    sent = spark.sparkContext.broadcast((sieve_of(places, places.count()), short))
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = F.col(own[docs.columns.index(text_col)])
    keyed = docs.toDF(*own).select("*", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    hits = keyed.where(text.isNotNull()).select("h1", "h2", text.alias("text")).mapInArrow(lambda batches: hit_batches(batches, sent, gram, window), HITS)
    near_bytes = 8 * (2 * window - gram) + 64
    begin, end = run_at(gram, window)
    joined = hits.join(sendable(places, near_bytes, sent_bytes), ["hash", "size"]).select("h1", "h2", "place", begin.alias("begin"), end.alias("end"))
    runs = scratch(joined.where("begin IS NOT NULL").distinct())
    spans = runs.groupBy("h1", "h2").agg(F.collect_set(F.struct("begin", "end")).alias("runs")).mapInArrow(merge_batches, "h1 long, h2 long, begins array<int>, ends array<int>")
    owners = scratch(prints.select(place, "item").distinct())
    named = runs.select("h1", "h2", "place").distinct().join(sendable(owners, 64, sent_bytes), "place").groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = scratch(spans.join(named, ["h1", "h2"]).withColumn("size", 24 + F.size("begins") * 8 + F.size("items") * 24))
    scratch.drop(found)
    size = found.agg(F.sum("size")).first()[0] or 0
    found = found.drop("size")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    at = docs.columns.index(text_col)
    schema = StructType([*keyed.schema.fields, StructField("n_words", LongType())])
    out = keyed.mapInArrow(lambda batches: size_batches(batches, own[at]), schema).join(F.broadcast(found) if size <= sent_bytes else found.hint("merge"), ["h1", "h2"], "left")
    out = out.select(*own, "n_words", none("begins", "int"), none("ends", "int"), none("items", "string"))
    names = list(docs.columns)
    for name in FOUND:
        while name in names:
            name += "_"
        names.append(name)
    return out.toDF(*names)


def summary(found: DataFrame) -> DataFrame:
    """A row for each document: counts of words, of hit words and of items, and a digest of the item ids."""
    hit = F.coalesce(F.aggregate(F.zip_with("ends", "begins", lambda b, a: b - a), F.lit(0), lambda total, n: total + n), F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
    SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
),
grams AS (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
),
hits AS (SELECT DISTINCT doc_id, n, i, item_id FROM grams JOIN wins USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
