"""A corpus, from documents to packed batches, by operators of ``paperledger.llm``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, all but the last with the columns of
documents. Rows with one doc_id stay or go together in near dedup; a row without doc_id is only judged by its own text.

Defined cases, besides those that the operators state: no rows give no rows with the same columns; columns that an
operator has a name for are kept as they are; texts that are null, empty or very long go the same way as others;
equal rows share their fate; in groups of near duplicates the rows of the least doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.llm import decontaminate, line_dedup, near_dup, packing, quality_classifier
from paperledger.llm.common import table
from paperledger.session import ship
from paperledger.tables import delete, new_path, own, release


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on the labelled ones, rejects."""
    scored = quality_classifier.scored(docs, table(spark, sf_dir, "labels"))
    name = scored.columns[-1]
    return scored.where(F.col(name) >= quality_classifier.THRESHOLD).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes passages that an earlier document has, and the documents of which no word is left by that."""
    ship(spark)
    name = _free(docs, "n_deleted")
    out = line_dedup.deduplicate(docs, name=name)
    out = out.where((F.col(name) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(name)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity of 0.8 or more)."""
    ship(spark)
    name = _free(docs, "gone_id")
    gone = near_dup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to batches of like lengths."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmarks), ("packing", pack)]

#: A trained classifier can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents; what each stage keeps is written in the shared folder.

    What a stage read and the tables that it made are deleted as soon as its own result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark, "stage"))
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
        release(spark, 0)
    return own(docs, before)
