"""Choice of documents to label, resumption, corrections and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.functions.text import numbers_in, squash, valid_date
from paperledger.operators.checks import printed
from paperledger.schema import AMOUNTS, FIELDS

# ---- Fixed values: audit messages. ----
PROBLEMS = ["no total", "total not in text", "invoice number not in text", "subtotal+tax != total", "bad date", "teacher says not an invoice"]


def candidates(classified: DataFrame, include_dir: str | None = None) -> DataFrame:
    """Readable documents that aren't sensitive and are bills or to review, or lie in the given folder."""
    wanted = F.col("verdict").isin("bill", "review")
    if include_dir:
        wanted = wanted | F.col("file").startswith(include_dir.rstrip("/") + "/")
    return classified.where(~F.col("verdict").isin("encrypted", "unreadable") & ~F.col("sensitive") & wanted)


def first_candidates(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in the order of the report, all without a limit."""
    return rows if limit is None else rows.orderBy(F.desc("score"), "file").limit(limit)


def unlabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select("sha256"), "sha256", "left_anti")


def label_status(rows: DataFrame, labels: DataFrame, answers: DataFrame) -> DataFrame:
    """(sha256, status): cached if there was a label, labelled if there is an answer now, else FAILED."""
    cached = rows.join(labels.select("sha256").distinct(), "sha256", "left_semi").select("sha256", F.lit("cached").alias("status"))
    fresh = unlabelled(rows, labels).join(answers.select("sha256", F.lit(True).alias("_got")).distinct(), "sha256", "left")
    return cached.unionByName(fresh.select("sha256", F.when(F.col("_got"), "labelled").otherwise("FAILED").alias("status")))


def corrected(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Labels with hand corrections: rows (sha256, field, value as text); a null value sets a field to null.

    Fields that begin with an underscore are ignored, and so are unknown ones. Of several corrections of one field
    the last one counts, by the column ``nth`` if there is one; on a tie the greatest text, and null only by itself.
    """
    order = F.struct(F.col("nth") if "nth" in corrections.columns else F.lit(0).alias("nth"), "value")
    last = corrections.where(F.col("field").isin(FIELDS)).groupBy("sha256", "field").agg(F.max(order)["value"].alias("value"))
    some = last.groupBy("sha256").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("_fix"))
    joined = labels.join(some, "sha256", "left")
    columns = []
    for c in labels.columns:
        if c in FIELDS:
            changed = F.coalesce(F.map_contains_key("_fix", c), F.lit(False))
            value = F.try_element_at("_fix", F.lit(c))["value"].try_cast(labels.schema[c].dataType)
            columns.append(F.when(changed, value).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def audit(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """The labels with ``problems`` and ``approved``. texts: sha256 and text, as read."""
    rows = labels.join(texts.select("sha256", F.col("text").alias("_text")), "sha256").withColumn("_numbers", numbers_in(F.col("_text")))
    number = F.col("invoice_number")
    tests = [
        F.col("total").isNull(),
        F.col("total").isNotNull() & ~printed(F.col("total"), F.col("_numbers")),
        (number != "") & ~squash(F.col("_text")).contains(squash(number)),
        F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) > 1,
        (F.col("invoice_date") != "") & ~valid_date(F.col("invoice_date")),
        ~F.coalesce("is_invoice", F.lit(False)),
    ]
    problems = F.concat_ws("; ", *(F.when(t, m) for t, m in zip(tests, PROBLEMS, strict=True)))
    rows = rows.withColumn("problems", problems).drop("_text", "_numbers")
    return rows.withColumn("approved", F.when(F.col("problems") == "", "auto").otherwise(""))


def review_sheet(audited: DataFrame) -> DataFrame:
    """The sheet's columns, as text, problems first."""
    shown = [F.when(F.col(c), "True").otherwise("False").alias(c) if c == "is_invoice" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS]
    return audited.select("problems", "approved", "file", *shown, "sha256").orderBy(F.col("problems") == "", "file")


def tally(audited: DataFrame) -> DataFrame:
    """(problem, n), most frequent first, ties by name."""
    each = audited.where("problems <> ''").select(F.explode(F.split("problems", "; ")).alias("problem"))
    return each.groupBy("problem").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "problem")


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("n_labels"), F.count_if(F.col("problems") == "").alias("n_clean"), F.count_if(F.col("problems") != "").alias("n_flagged"))


def typed_review(sheet: DataFrame) -> DataFrame:
    """A review sheet as read (all text) with its fields typed; blanks are null, ``True`` alone is true."""
    columns = []
    for c in sheet.columns:
        value = F.nullif(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""), F.lit(""))
        if c == "is_invoice":
            columns.append(F.coalesce(value == "True", F.lit(False)).alias(c))
        elif c in AMOUNTS:
            columns.append(value.try_cast("decimal(18,2)").alias(c))
        elif c in FIELDS:
            columns.append(value.alias(c))
        else:
            columns.append(F.col(c))
    return sheet.select(*columns)
