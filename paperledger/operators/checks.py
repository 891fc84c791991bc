"""Repair and checks of a record against the text it came from.

Each step is a projection of its own, since later steps see what earlier ones changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.functions.record import amount_field, clean, complete, listed, only
from paperledger.functions.text import digits, numbers_in, one_digit_apart, valid_gstin
from paperledger.schema import AMOUNTS, FIELDS
from paperledger.tables import once

# ---- Fixed values: check messages. ----
SNAPPED = "{} snapped to printed amount"
BAD_GSTIN, NOT_FOUND, NO_TOTAL = "invalid gstin dropped", "total not found in text", "no total"
DERIVED, MISMATCH, GUIDED, OK = "tax derived as total - subtotal", "subtotal+tax != total", "fields filled one at a time", "ok"


def printed(amount: Column, numbers: Column) -> Column:
    return F.coalesce(F.array_contains(numbers, amount), F.lit(False))


def snap_to_printed(records: DataFrame, numbers: str = "numbers") -> DataFrame:
    """Replaces subtotal and total by the only printed amount one digit away, unless they are printed themselves.

    Adds ``near_subtotal`` and ``near_total``: the amounts that came in, else null.
    """
    for field in ("subtotal", "total"):
        own = digits(F.col(field))
        near = F.filter(F.col(numbers), lambda n: one_digit_apart(own, digits(n)))  # noqa: B023
        records = once(records, _near=F.when(F.col(field).isNotNull() & ~printed(F.col(field), F.col(numbers)), near))
        records = records.withColumn(f"near_{field}", F.when(F.size("_near") == 1, F.element_at("_near", 1))).drop("_near")
        records = records.withColumn(field, F.coalesce(f"near_{field}", field))
    return records


def check(records: DataFrame, text_col: str = "text") -> DataFrame:
    """The records, repaired, with ``check``: what was done or is wrong, or ``ok``."""
    rows = snap_to_printed(once(records.drop("numbers"), numbers=numbers_in(F.col(text_col))))
    rows = rows.withColumn("_bad_gstin", F.coalesce(F.col("gstin") != "", F.lit(False)) & ~F.coalesce(valid_gstin(F.col("gstin")), F.lit(False)))
    rows = rows.withColumn("gstin", F.when(~F.col("_bad_gstin"), F.col("gstin")))
    wrong = F.coalesce(F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) > 1, F.lit(False))
    grounded = printed(F.col("subtotal"), F.col("numbers")) & printed(F.col("total"), F.col("numbers"))
    rows = rows.withColumn("_wrong", wrong).withColumn("_derive", wrong & (F.col("total") >= F.col("subtotal")) & grounded)
    rows = rows.withColumn("tax", F.when(F.col("_derive"), (F.col("total") - F.col("subtotal")).cast("decimal(18,2)")).otherwise(F.col("tax")))
    notes = F.concat_ws(
        "; ",
        *(F.when(F.col(f"near_{f}").isNotNull(), SNAPPED.format(f)) for f in ("subtotal", "total")),
        F.when(F.col("_bad_gstin"), BAD_GSTIN),
        F.when(F.col("total").isNull(), NO_TOTAL).when(~printed(F.col("total"), F.col("numbers")), NOT_FOUND),
        F.when(F.col("_derive"), DERIVED).when(F.col("_wrong"), MISMATCH),
    )
    rows = rows.withColumn("check", F.when(notes == "", OK).otherwise(notes))
    return rows.drop("numbers", "near_subtotal", "near_total", "_bad_gstin", "_wrong", "_derive")


def guided_check(check: Column, guided: Column) -> Column:
    """Marks the check of a record whose fields were filled one at a time."""
    return F.when(guided, F.when(check == OK, GUIDED).otherwise(F.concat(F.lit(GUIDED + "; "), check))).otherwise(check)


def typed(answers: DataFrame, output_col: str = "output") -> DataFrame:
    """Adds the typed fields of an answer, and ``guided``: whether it lacks an object or some field of it."""
    parsed = once(answers, _listed=listed(F.col(output_col))).withColumn("_object", only(F.col("_listed")))
    parsed = once(parsed, **{f"_{f}": amount_field(F.col("_object"), f) for f in AMOUNTS})
    fields = [F.col(f"_{f}").alias(f) if f in AMOUNTS else c for f, c in zip(FIELDS, clean(F.col("_object")), strict=True)]
    return parsed.select(*answers.columns, incomplete(F.col("_object"), F.col(output_col)).alias("guided"), *fields)


def incomplete(value: Column, output: Column) -> Column:
    """Whether an answer lacks an object or some field of it."""
    return value.isNull() | ~F.coalesce(complete(output), F.lit(False))


def ledger(extracted: DataFrame) -> DataFrame:
    """(file, fields, check) of rows with (file, status, text, guided, fields). Rows that aren't ok keep no field;
    their check is the status. All rows go the same way once, so what they come from is evaluated once."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    rows = extracted.select("file", "status", "guided", ok.alias("_ok"), F.when(ok, F.col("text")).alias("text"), *(F.when(ok, F.col(f)).alias(f) for f in FIELDS))
    return check(rows).select("file", *FIELDS, F.when(F.col("_ok"), guided_check(F.col("check"), F.col("guided"))).otherwise(F.col("status")).alias("check"))


def whole_amounts(row: dict) -> dict:
    """A row for display: amounts without cents are integers."""
    return {k: int(v) if k in AMOUNTS and v is not None and v == int(v) else v for k, v in row.items()}
