"""Quality rules for documents and hosts, in DataFrame functions only.

Each text gets its counts in one projection over its array of words; nothing is exploded, so the only
shuffle is that of host totals. Hosts get the number of documents that break some rule; their rates are
shrunk by a beta prior fitted to the hosts by moments, and documents of hosts that mostly fail are dropped.

The counts are stored, so that the texts are read once and the join of host verdicts has plain scans
on both sides: Spark broadcasts the rejected hosts if they are small, else splits a host of very many rows.

Defined cases: null texts have no words and fail; texts without words fail; a null host has no verdict;
repeated rows count each; an empty table gives no rows; other columns are ignored. Texts of any length take
time in proportion to n log n of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Further rules, for hosts: symbols and repeated lines by words and lines, bounds of the mean length of words.
SYMBOL_PERCENT, DUP_LINE_PERCENT, SHORTEST, LONGEST = 30, 50, 2, 20
#: Hosts whose shrunk rate of failing documents is at least this are rejected.
HOST_RATE = 0.5
#: Bounds of the weight of the prior, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6

SPACE = r"[\x20\x09-\x0D]+"


def rest(array: Column, start: int) -> Column:
    """The elements of an array from the one at ``start`` on."""
    return F.slice(array, start, F.greatest(F.size(array), F.lit(1)))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    The arrays are made in projections of their own: each is used more than once, so Spark keeps them apart
    and makes each once. Hashes of windows are sorted with their places only where some hash repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, grams, placed = F.col("words"), F.col("grams"), F.col("placed")
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    pairs = F.zip_with(words, rest(words, 2), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, rest(words, 3), lambda h, c: F.when(c.isNotNull(), F.xxhash64(h, c)))
    counted = split.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        triples.alias("grams"),
    )
    # The two last hashes are null, for the places where no window starts.
    repeats = F.size(F.array_distinct(grams)) + 1 < F.size(grams)
    sorted_places = F.sort_array(F.filter(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isNotNull()))
    kept = [c for c in counted.columns if c != "grams"]
    sorted_rows = counted.select(*kept, F.when(repeats, sorted_places).alias("placed"))
    twice = F.zip_with(placed, rest(placed, 2), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)))
    n_repeat = F.when(placed.isNull(), 0).otherwise(F.size(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    return sorted_rows.select(*kept, n_repeat.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """Whether a document breaks any rule, the base rules among them."""
    return (
        base_failed()
        | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < SHORTEST * F.col("n_words"))
        | (F.col("word_chars") > LONGEST * F.col("n_words"))
    )


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): the share of failing documents, shrunk by the empirical beta prior."""
    hosts = counted.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if(rule_failed()).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.var_pop(raw)).first()
    mean, spread = mean or 0.0, spread or 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, LEAST_PRIOR), MOST_PRIOR) if spread > 0 else MOST_PRIOR
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: its counts, ``base_failed``, and ``kept`` (false also if its host is rejected)."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch(counts(docs, id_col, text_col, host_col))
    rejected = scratch(host_rates(counted).where(F.col("rate") >= HOST_RATE).select("host", F.lit(True).alias("rejected")))
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    joined = counted.join(rejected, "host", "left").withColumn("base_failed", base_failed())
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents
),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id
),
c AS (
    SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id
),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c),
h AS (
    SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > {SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines
        OR word_chars < {SHORTEST} * n_words OR word_chars > {LONGEST} * n_words) AS k
    FROM f WHERE source IS NOT NULL GROUP BY source
),
m AS (SELECT sum(k) / sum(n) AS mean, var_pop(k / n) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, {LEAST_PRIOR}), {MOST_PRIOR}) ELSE {MOST_PRIOR} END AS weight FROM m),
b AS (SELECT source FROM h, p WHERE (k + mean * weight) / (n + weight) >= {HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM b)) AS kept FROM f
"""
