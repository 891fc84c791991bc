"""Scores of answers against what is expected, by field and by document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.functions.record import amount_field, amount_of, kind, listed, only, text_field, text_fields
from paperledger.functions.text import norm
from paperledger.schema import AMOUNTS, SCORED
from paperledger.tables import once


#: So many fields are compared by one generated method; one of over 8,000 bytes isn't compiled by the JVM.
AT_ONCE = 3


def field_correct(field: str, answer: Column, want: Column) -> Column:
    """Whether a field of an answer (a variant) equals the expected value. Amounts may differ by a cent; of two
    vendor names one may hold the other; else letters and digits count."""
    if field in AMOUNTS:
        return _amount_correct(amount_field(answer, field), kind(answer, field), want)
    return _text_correct(field, text_field(answer, field), want)


def _text_correct(field: str, got: Column, want: Column) -> Column:
    equal = F.coalesce(got == want.cast("string"), F.lit(False))  # most are; then there is nothing to normalise
    same = equal | norm(got).eqNullSafe(norm(want))
    if field == "vendor":
        either = equal | norm(got).contains(norm(want)) | norm(want).contains(norm(got))
        return F.when((got != "") & (want != ""), either).otherwise(same)
    return same


def _amount_correct(got: Column, kind: Column, want: Column) -> Column:
    """kind: that of the value in the answer. Where something is there that isn't an amount, it is wrong."""
    close = F.coalesce(F.abs(got - want) <= 0.01, F.lit(False))
    unparseable = (F.coalesce(kind, F.lit("VOID")) != "VOID") & got.isNull()
    return ~unparseable & F.when(got.isNull() | want.isNull(), got.isNull() & want.isNull()).otherwise(close)


def _answered(both: DataFrame) -> DataFrame:
    """The rows with what ``_correct`` looks at, made once for a row."""
    both = once(both, _listed=listed(F.col("output"))).withColumn("_object", only(F.col("_listed")))
    kinds = once(both, _texts=text_fields(F.col("_object")), **{f"_kind_{f}": kind(F.col("_object"), f) for f in AMOUNTS})
    return once(kinds, **{f"_got_{f}": amount_of(F.col(f"_kind_{f}"), F.col("_texts")[f]) for f in AMOUNTS})


def _correct(field: str) -> Column:
    right = _amount_correct(F.col(f"_got_{field}"), F.col(f"_kind_{field}"), F.col(field)) if field in AMOUNTS else _text_correct(field, F.col("_texts")[field], F.col(field))
    return F.col("_object").isNotNull() & right


def judge(answers: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document and scored field: (key, model, seconds, valid, field, correct, got, want).

    answers: key, model, output, seconds. wanted: key and the fields.
    """
    return judge_joined(answers.join(wanted.select(key, *SCORED), key), key)


def judge_joined(both: DataFrame, key: str = "doc_id") -> DataFrame:
    """``judge`` of rows that hold an answer and what is wanted: key, model, output, seconds and the fields."""
    both = _answered(both)
    valid = F.col("_object").isNotNull()
    fields = [
        F.struct(
            F.lit(f).alias("field"),
            _correct(f).alias("correct"),
            F.col("_texts")[f].alias("got"),
            F.col(f).cast("string").alias("want"),
        )
        for f in SCORED
    ]
    rows = both.select(key, "model", "output", "seconds", valid.alias("valid"), F.explode(F.array(*fields)).alias("x"))
    return rows.select(key, "model", "output", "seconds", "valid", "x.*")


def totals(both: DataFrame) -> DataFrame:
    """(model, n, n_valid, n_exact, mean_seconds, right) of rows as for ``judge_joined``, one for each document and model.
    right: the numbers of right answers by ``SCORED``. No row is made for a field, and none is shuffled."""
    marked = _answered(both).withColumn("_valid", F.col("_object").isNotNull())
    for i in range(0, len(SCORED), AT_ONCE):
        marked = once(marked, **{f"_right_{f}": _correct(f) for f in SCORED[i : i + AT_ONCE]})
    exact = reduce(lambda x, y: x & y, (F.col(f"_right_{f}") for f in SCORED), F.col("_valid"))
    right = F.array(*(F.count_if(F.col(f"_right_{f}")) for f in SCORED)).alias("right")
    return marked.groupBy("model").agg(F.count("*").alias("n"), F.count_if("_valid").alias("n_valid"), F.count_if(exact).alias("n_exact"), F.avg("seconds").alias("mean_seconds"), right)


def accuracy_of(total: DataFrame) -> DataFrame:
    """``field_accuracy`` out of ``totals``."""
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, SCORED)).alias("field"), F.col("right").alias("n_correct"))).alias("x")
    return total.select("model", "n", each).select("model", "x.field", "n", "x.n_correct")


def misses_of(total: DataFrame) -> DataFrame:
    """(model, field, n): the numbers of ``misses`` out of ``totals``."""
    each = [F.struct(F.lit(f).alias("field"), (F.col("n_valid") - F.col("right")[i]).alias("n")) for i, f in enumerate(SCORED)]
    each.append(F.struct(F.lit("invalid json").alias("field"), (F.col("n") - F.col("n_valid")).alias("n")))
    return total.select("model", F.explode(F.array(*each)).alias("x")).select("model", "x.*").where("n > 0")


def report_of(total: DataFrame, models: list[str]) -> DataFrame:
    """``report`` out of ``totals``."""
    shares = [F.struct(F.lit(f).alias("metric"), percent(F.col("right")[i], F.col("n")).alias("share")) for i, f in enumerate(SCORED)]
    shares += [F.struct(F.lit(m).alias("metric"), percent(F.col(c), F.col("n")).alias("share")) for m, c in (("valid JSON", "n_valid"), ("ALL fields right", "n_exact"))]
    return total.select("model", F.inline(F.array(*shares))).groupBy("metric").pivot("model", models).agg(F.first("share"))


def field_accuracy(judged: DataFrame) -> DataFrame:
    """(model, field, n, n_correct): invalid answers count as wrong in every field."""
    return judged.groupBy("model", "field").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


def document_scores(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(model, n, n_valid, n_exact, mean_seconds)."""
    docs = judged.groupBy("model", key).agg(F.first("valid").alias("valid"), F.bool_and("correct").alias("exact"), F.first("seconds").alias("seconds"))
    return docs.groupBy("model").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & F.col("exact")).alias("n_exact"), F.avg("seconds").alias("mean_seconds"))


def misses(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, model, field, detail): what was got and wanted; the start of an answer that isn't valid."""
    wrong, broken = F.col("valid") & ~F.col("correct"), ~F.col("valid") & (F.col("field") == SCORED[0])
    detail = F.concat(F.lit("got "), F.coalesce("got", F.lit("null")), F.lit(" want "), F.coalesce("want", F.lit("null")))
    found = judged.where(wrong | broken)  # one reading of what is judged, not one for either kind
    return found.select(key, "model", F.when(F.col("valid"), F.col("field")).otherwise("invalid json").alias("field"), F.when(F.col("valid"), detail).otherwise(F.left("output", F.lit(80))).alias("detail"))


def percent(part: Column, whole: Column) -> Column:
    """A share as a text of whole percents; halves go to the even one, as in printed reports."""
    return F.concat(F.bround(part * 100 / whole, 0).cast("int").cast("string"), F.lit("%"))


def report(judged: DataFrame, models: list[str], key: str = "doc_id") -> DataFrame:
    """(metric, a column for each model): valid answers, each field, and documents with all fields right, in percents."""
    fields = field_accuracy(judged).select(F.col("field").alias("metric"), "model", percent(F.col("n_correct"), F.col("n")).alias("share"))
    docs = document_scores(judged, key)
    whole = docs.select("model", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), percent(F.col(c), F.col("n")).alias("share")) for m, c in (("valid JSON", "n_valid"), ("ALL fields right", "n_exact"))))).alias("x"))
    return fields.unionByName(whole.select("model", "x.*")).groupBy("metric").pivot("model", models).agg(F.first("share"))


def head_to_head(accuracy: DataFrame, models: list[str]) -> DataFrame:
    """A row for each field with a column for each model's share of correct answers, in thousandths."""
    rate = F.floor(F.first("n_correct") * 1000 / F.first("n")).cast("long")
    return accuracy.groupBy("field").pivot("model", models).agg(rate)
