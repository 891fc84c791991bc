"""Queries that write what the stages leave behind, read it back and compare, and queries whose order counts.

Each writes to a folder of its own, which goes when its result isn't used any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.functions import record, text
from paperledger.operators import dataset, evaluation, labels, reports, scoring
from paperledger.plans import bills as view
from paperledger.plans.bills import sql_bills, sql_labels, sql_numbers, table
from paperledger.plans.catalog import _AUDIT, _CHECKED, _CLASSIFIED, _GROUPS, _JUDGED, _audited, _classified, _copies, _ledger, _totals, query
from paperledger.schema import FIELDS, SCORED
from paperledger.sources import extract, files, sinks
from paperledger.tables import Scratch, delete, file_system, new_path, numbered, own

_NAMES = ", ".join(FIELDS)


def _supplier_files(s: SparkSession, d: str) -> str:
    """A folder with a text file for each supplier, some of them alike, in folders by nation and number."""
    path = new_path(s, "files")
    named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in ("s_nationkey", "s_suppkey")]
    value = F.concat(F.lit("INVOICE\n"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("same")).otherwise(F.col("s_name")), F.lit("\n"))
    rows = table(s, d, "supplier").select(F.concat_ws("/", *named).alias("folder"), F.concat(F.lit("part-"), F.monotonically_increasing_id().cast("string"), F.lit(".txt")).alias("name"), F.coalesce(value, F.lit("\n")).alias("value"))
    sinks.write_texts(rows, path)
    return path


def _scanned(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    path = _supplier_files(s, d)
    return own(files.scan(s, path, suffixes=False), path), path


_PLACE = "'s_nationkey=' || CAST(s_nationkey AS VARCHAR) || '/s_suppkey=' || CAST(s_suppkey AS VARCHAR)"
_CONTENT = "'INVOICE' || chr(10) || CASE WHEN s_suppkey % 5 = 0 THEN 'same' ELSE s_name END || chr(10)"
_FILES = f"WITH f AS (SELECT {_PLACE} AS folder, {_CONTENT} AS content FROM supplier)"


def _folder(path: F.Column, root: str) -> F.Column:
    """A path below the root without the file's own name, which Spark makes up."""
    return F.regexp_replace(files.relative(path, root), "/[^/]*$", "")


@query("scan_files", f"{_FILES} SELECT folder, sha256(content) AS sha256, CAST(length(content) AS BIGINT) AS length FROM f")
def scan_files(s: SparkSession, d: str) -> DataFrame:
    found, root = _scanned(s, d)
    return found.select(_folder(F.col("path"), root).alias("folder"), F.sha2("content", 256).alias("sha256"), "length")


@query("scan_unique", f"{_FILES} SELECT sha256(content) AS sha256, min_by(folder, string_split(folder, '/')) AS folder FROM f GROUP BY 1")
def scan_unique(s: SparkSession, d: str) -> DataFrame:
    found, root = _scanned(s, d)
    return files.unique_files(found).select("sha256", _folder(F.col("path"), root).alias("folder"))


@query("extract_files", f"{_FILES} SELECT sha256(content) AS sha256, min_by(folder, string_split(folder, '/')) AS folder, '--- page 1 ---' || chr(10) || content AS text, 1 AS page_count, 'ok' AS status FROM f GROUP BY content")
def extract_files(s: SparkSession, d: str) -> DataFrame:
    found, root = _scanned(s, d)
    read = extract.extract(extract.with_content(files.unique_files(found), found))
    return read.select("sha256", _folder(F.col("file"), root).alias("folder"), "text", "page_count", "status")


@query("input_list", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 < 2")
def input_list(s: SparkSession, d: str) -> DataFrame:
    """Files of some folders, and one folder that isn't there."""
    path = new_path(s, "inputs")
    rows = table(s, d, "supplier").select((F.col("s_suppkey") % 10).alias("part"), "s_suppkey", F.col("s_suppkey").cast("string").alias("content"))
    rows.repartition("part").write.partitionBy("part").csv(path)
    for file in files.scan(s, path, suffixes=False).select("path").collect():  # ten files and a mark
        start, system = file_system(s, file["path"])
        system.rename(start, file_system(s, file["path"].rsplit(".", 1)[0] + ".pdf")[0])
    found = own(files.inputs(s, [f"{path}/part=0", f"{path}/part=1", f"{path}/part=99"]), path)
    lines = found.select(F.explode(F.split(F.rtrim(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit(" "))), " ")).alias("x"))
    return lines.select(F.element_at(F.split("x", ","), 1).cast("long").alias("s_suppkey"))


def _stored(df: DataFrame, name: str, write, read) -> DataFrame:
    """What ``read`` finds after ``write``."""
    path = new_path(df.sparkSession, name)
    write(df, path)
    return own(read(df.sparkSession, path), path)


@query("text_cache", f"WITH {sql_bills()} SELECT sha256, text FROM bills WHERE status = 'ok'")
def text_cache(s: SparkSession, d: str) -> DataFrame:
    return _stored(view.bills(s, d), "texts", sinks.write_text_cache, files.text_cache)


@query("classification_csv", f"{_CLASSIFIED} SELECT sha256, file, verdict, score, pages, ocr_pages, sensitive, nullif(reasons, '') AS reasons FROM classified")
def classification_csv(s: SparkSession, d: str) -> DataFrame:
    return _stored(_classified(s, d), "classification", sinks.write_csv, files.classification).withColumn("reasons", F.nullif("reasons", F.lit("")))


@query("review_csv", f"{_AUDIT} SELECT sha256, file, problems, CASE WHEN problems = '' THEN 'auto' ELSE '' END AS approved, {_NAMES} FROM audited")
def review_csv(s: SparkSession, d: str) -> DataFrame:
    """The sheet as a person gets it back."""
    sheet = labels.review_sheet(Scratch(s)(_audited(s, d)))  # to sort reads what it sorts twice
    path = new_path(s, "review")
    sinks.write_csv(sheet, path)
    raw = files.review(s, path)
    typed = labels.typed_review(raw).select("sha256", "file", "problems", "approved", *FIELDS)
    return _kept(typed, s, path)


def _kept(df: DataFrame, s: SparkSession, path: str) -> DataFrame:
    """df, whose files go when it does."""
    out = Scratch(s)(df)
    delete(s, path)
    return out


@query("result_csv", f'{_CHECKED} SELECT file, {_NAMES}, "check" FROM ledger')
def result_csv(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "results")
    sinks.write_csv(_ledger(s, d), path)
    return _kept(files.results(s, path), s, path)


@query("label_lines", f"WITH {sql_bills()}, {sql_labels()} SELECT sha256, {_NAMES}, file, 'teacher' AS teacher FROM labels0")
def label_lines(s: SparkSession, d: str) -> DataFrame:
    rows = view.labels(view.bills(s, d)).withColumn("teacher", F.lit("teacher"))
    path = new_path(s, "labels")
    sinks.write_labels(rows, path)
    return _kept(files.label_lines(s, path), s, path)


@query("corrections_json", "SELECT CAST(c_custkey AS VARCHAR) AS sha256, 'vendor' AS field, c_name AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'total', NULL FROM customer WHERE c_custkey % 2 = 0")
def corrections_json(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer")
    fix = F.concat(F.lit('{"'), F.col("c_custkey").cast("string"), F.lit('": {"vendor": '), F.regexp_replace(F.to_json(F.array("c_name")), r"^\[|\]$", ""), F.when(F.col("c_custkey") % 2 == 0, ', "total": null').otherwise(""), F.lit("}}"))
    path = new_path(s, "corrections")
    merged = rows.select(fix.alias("value"))
    # A file holds one object: each part's objects are joined to one.
    joined = merged.groupBy(F.spark_partition_id().alias("p")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list("value"), lambda v: F.substring(v, F.lit(2), F.length(v) - 2)), ","), F.lit("}")).alias("value"))
    joined.select("value").repartition(1).write.text(path)
    return _kept(files.corrections(s, path).select("sha256", "field", "value"), s, path)


@query("chat_jsonl", f"""{_GROUPS} SELECT split, count(*) AS n, CAST(sum(length(b.text)) AS BIGINT) AS n_chars FROM keyed k JOIN split USING (group_key) JOIN bills b ON b.sha256 = k.sha256 GROUP BY split""")
def chat_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Training sets as JSON lines, a folder for each split."""
    path = new_path(s, "chats")
    sinks.write_splits(dataset.chat(dataset.split_rows(_copies(s, d)).drop("text"), view.bills(s, d).select("sha256", "text")), path)
    read = files.chat_examples(s, path, splits=True)
    asked = F.element_at(dataset.request(F.col("messages")), -1)["content"]
    return _kept(read.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length(asked) - len(text.DOCUMENT)).alias("n_chars")), s, path)


@query("test_files", f"{_GROUPS} SELECT file, k.sha256 FROM keyed k JOIN split USING (group_key) WHERE split = 'test'")
def test_files(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "pinned")
    sinks.write_test_files(dataset.split_rows(_copies(s, d)), path)
    return _kept(files.pinned(s, path), s, path)


# ---- order ----

query("report_order", f"{_CLASSIFIED} SELECT file, score, row_number() OVER (ORDER BY score DESC, file) AS place FROM classified")(
    lambda s, d: numbered(scoring.report_order(Scratch(s)(_classified(s, d).select("file", "score")))))
query("review_order", f"{_AUDIT} SELECT file, row_number() OVER (ORDER BY problems = '', file) AS place FROM audited")(
    lambda s, d: numbered(labels.review_sheet(Scratch(s)(_audited(s, d)))).select("file", "place"))
query("tally_order", f"{_AUDIT}, t AS (SELECT problem, count(*) AS n FROM (SELECT unnest(string_split(problems, '; ')) AS problem FROM audited WHERE problems <> '') GROUP BY problem) SELECT problem, row_number() OVER (ORDER BY n DESC, problem) AS place FROM t")(
    lambda s, d: numbered(labels.tally(_audited(s, d))).select("problem", "place"))
query("spend_order", f"{_CHECKED}, t AS (SELECT vendor, currency, sum(total) AS spend FROM ledger WHERE is_invoice AND total IS NOT NULL GROUP BY vendor, currency) SELECT vendor, currency, row_number() OVER (ORDER BY spend DESC, vendor, currency) AS place FROM t")(
    lambda s, d: numbered(reports.spend_by_vendor(_ledger(s, d))).select("vendor", "currency", "place"))
query("path_order", "SELECT sha256(c_mktsegment) AS sha256, min_by(path, string_split(path, '/')) AS path FROM (SELECT c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN 'a-b/' WHEN 1 THEN 'a/' ELSE 'a.b/' END || CAST(c_custkey AS VARCHAR) AS path FROM customer) GROUP BY 1")(
    lambda s, d: reports.content_dedup(table(s, d, "customer").select("c_mktsegment", F.concat(F.element_at(F.array(F.lit("a-b/"), F.lit("a/"), F.lit("a.b/")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_custkey").cast("string")).alias("path")), "c_mktsegment", "path"))

# ---- digits of other scripts, ends of running values, details ----

query("foreign_digits", f"WITH {sql_bills()} SELECT key, array_to_string(list_transform(list_sort({sql_numbers('text')}), lambda x: CAST(x AS VARCHAR)), ' ') AS numbers, CAST(total AS DECIMAL(18,2)) AS amount FROM bills")(
    lambda s, d: view.bills(s, d).select("key", F.when(F.col("key") % 2 == 0, F.translate("text", "0123456789", "०१२३४५६७८९")).otherwise(F.translate("text", "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("text"), F.translate(F.concat(F.lit("₹ "), view.western(F.col("total"))), "0123456789", "०१२३४५६७८९").alias("shown")).select(
        "key", F.array_join(F.transform(F.array_sort(text.numbers_in(F.col("text"))), lambda x: x.cast("string")), " ").alias("numbers"), record.as_number(F.col("shown")).alias("amount")))
query("value_ends", f"WITH {sql_bills()} SELECT key, CASE key % 3 WHEN 0 THEN CAST(to_json(vendor || ', \"' || customer) AS VARCHAR) WHEN 1 THEN CAST(total AS VARCHAR) ELSE 'null' END AS value FROM bills")(
    lambda s, d: view.bills(s, d).select("key", F.when(F.col("key") % 3 == 0, F.concat(F.regexp_replace(F.to_json(F.array(F.concat("vendor", F.lit(', "'), "customer"))), r"^\[|\]$", ""), F.lit(', "x": 1'))).when(F.col("key") % 3 == 1, F.concat(F.col("total").cast("string"), F.lit('} "'))).otherwise("null, 1}").alias("t")).select("key", record.value_end(F.col("t")).alias("value")))


def _percent(part: str, whole: str) -> str:
    """Halves go to the even one; shares are exact in thousandths of percents."""
    return f"CAST(CAST(round_even({part} * 100.0 / {whole}, 0) AS INTEGER) AS VARCHAR) || '%'"


def _share(metric: str, hit: str) -> str:
    return f"SELECT '{metric}' AS metric, " + ", ".join(_percent(f"count(*) FILTER ({hit} AND model = '{m}')", f"count(*) FILTER (model = '{m}')") + f" AS {m}" for m in ("base", "tuned")) + " FROM judged"


def _report(s: SparkSession, d: str) -> DataFrame:
    return evaluation.report_of(_totals(s, d), ["base", "tuned"])


query("percent_report", f"{_JUDGED} " + " UNION ALL ".join([*(_share(f, f"c_{f}") for f in SCORED), _share("valid JSON", "valid"), _share("ALL fields right", "valid AND " + " AND ".join(f"c_{f}" for f in SCORED))]))(_report)
