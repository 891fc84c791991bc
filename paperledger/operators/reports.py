"""Duplicates and reports over ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.operators.dataset import vendor_key


def content_dedup(files: DataFrame, content_col: str, path_col: str) -> DataFrame:
    """(sha256, path): the first path of each content. Text paths are compared part by part, like folders.

    Only hashes and paths are shuffled, and partly aggregated first, so a content of very many copies is cheap.
    """
    content = F.col(content_col)
    order = F.split(path_col, "/") if files.schema[path_col].dataType.simpleString() == "string" else F.col(path_col)
    hashed = files.select(F.sha2(content.cast("binary"), 256).alias("sha256"), F.col(path_col).alias("path"), order.alias("_order"))
    return hashed.groupBy("sha256").agg(F.min_by("path", "_order").alias("path"))


def content_counts(files: DataFrame, content_col: str) -> DataFrame:
    """(n_files, n_unique)."""
    hashed = files.select(F.sha2(F.col(content_col).cast("binary"), 256).alias("sha256"))
    per_content = hashed.groupBy("sha256").agg(F.count("*").alias("n"))
    return per_content.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.count("sha256").alias("n_unique"))


def spend_by_vendor(ledger: DataFrame) -> DataFrame:
    """(vendor, currency, spend, n_bills) of invoices with a total, largest first."""
    paid = ledger.where("is_invoice AND total IS NOT NULL")
    return paid.groupBy("vendor", "currency").agg(F.sum("total").cast("decimal(38,2)").alias("spend"), F.count("*").alias("n_bills")).orderBy(F.desc("spend"), "vendor", "currency")


def addressed_to(ledger: DataFrame, name: str) -> DataFrame:
    return ledger.where(F.lower("customer").contains(name.lower()))


def dedup_bills(ledger: DataFrame, file_col: str = "file") -> DataFrame:
    """One row, that of the first file, for each vendor, number (the file where there is none) and total."""
    number = F.coalesce(F.nullif(F.col("invoice_number"), F.lit("")), F.col(file_col))
    keyed = ledger.withColumn("_vendor", vendor_key(F.col("vendor"))).withColumn("_number", number).withColumn("_row", F.struct(*ledger.columns))
    first = keyed.groupBy("_vendor", "_number", "total").agg(F.min_by("_row", F.col(file_col)).alias("_row"))
    return first.select("_row.*")
