"""Bounded samples of labelled rows, for fitting models on the driver.

A sample holds the ``per_class`` rows of each class that come first by a hash of their id, so it does not
depend on partitioning. Its rows come with their whole texts, but a row of more than ``MOST_CHARS`` characters is
left out of a sample as a whole, which bounds what reaches the driver. Prediction never uses a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a text that may be in a sample.
MOST_CHARS = 50_000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def first_rows(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """Of (doc_id, label) the first ``per_class`` rows of each value, by a hash of the id, in one pass for all values.

    Of each part of the table only that many rows of a value are shuffled, if they are 1,000 at most.
    """
    nth = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= per_class).drop("_nth")


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of either label whose id is not in the held-out fold.

    The ids have a proven bound of two times ``per_class``, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), fold) != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= MOST_CHARS)
    return slim.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
