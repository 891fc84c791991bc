"""The stages from a folder of files to a ledger, each a function from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.functions.record import clean, parse_object
from paperledger.functions.text import prepare
from paperledger.operators import checks, scoring
from paperledger.sources import extract, files, model


def extracted(spark: SparkSession, folder: str, extractor: Callable[[bytes, str], extract.Extraction] = extract.plain_text, partitions: int | None = None, suffixes: bool = True) -> DataFrame:
    """The text of each distinct content below a folder."""
    found = files.scan(spark, folder, suffixes)
    read = extract.extract(extract.with_content(files.unique_files(found), found), extractor, partitions)
    return read.withColumn("file", files.relative(F.col("file"), folder))


def classified(texts: DataFrame) -> DataFrame:
    return scoring.classify(texts)


def to_ledger(texts: DataFrame, backend: Callable[[], model.Backend] = model.RuleBackend) -> DataFrame:
    """(file, fields, check) of extracted texts. Each readable one goes to the model once; answers that lack an object
    or a field are asked for again, a field at a time. There are no branches, so nothing is asked for twice."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    rows = texts.select("file", "status", "text", F.when(ok, prepare(F.col("text"))).alias("prepared"))
    first = model.answers(rows, backend).drop("error")
    asked = first.withColumn("guided", F.col("prepared").isNotNull() & checks.incomplete(parse_object(F.col("output")), F.col("output")))
    second = model.guided_answers(asked, backend).drop("error", "prepared")
    parsed = second.withColumn("_object", parse_object(F.col("output")))
    return checks.ledger(parsed.select("file", "status", "text", "guided", *clean(F.col("_object"))))
