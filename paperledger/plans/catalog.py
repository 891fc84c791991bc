"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.functions import record, text
from paperledger.operators import checks, dataset, evaluation, labels, reports, scoring
from paperledger.plans import bills as view
from paperledger.plans.bills import sql_answers, sql_bills, sql_labels, sql_numbers, table
from paperledger.schema import AMOUNTS as AMOUNT_FIELDS
from paperledger.schema import FIELDS, HEAD_CHARS, MAX_CHARS, SCORED
from paperledger.tables import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHOWN = [f for f in FIELDS if f != "category"]
AMOUNTS = "subtotal, tax, total"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.bills(spark, sf_dir).withColumn("page_count", F.col("pages"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(_extracted(spark, sf_dir))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = view.answers(view.bills(spark, sf_dir)).select("key", "sha256", "file", "status", "text", "output")
    return checks.typed(answers)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ledger(_typed(spark, sf_dir))


def _label_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = Scratch(spark)(view.bills(spark, sf_dir).select("sha256", "key"))
    return labels.label_status(labels.candidates(_classified(spark, sf_dir)), known.where("key % 4 = 0").select("sha256"), known.where("key % 5 <> 0").select("sha256"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view.bills(spark, sf_dir)
    return labels.audit(view.labels(rows).drop("text"), rows.select("sha256", "text"))


# ---- duplicates of content ----

query("content_dedup", "SELECT sha256(text) AS sha256, min(doc_id) AS path FROM documents GROUP BY 1")(
    lambda s, d: reports.content_dedup(table(s, d, "documents"), "text", "doc_id"))

query("content_counts", "SELECT CAST(count(*) AS BIGINT) AS n_files, count(DISTINCT sha256(text)) AS n_unique FROM documents")(
    lambda s, d: reports.content_counts(table(s, d, "documents"), "text"))

# ---- scoring ----


def _re(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


_CLAUSES = [(f"regexp_matches(text, {_re(p)})", w, label) for p, w, label in scoring.RULES]
_CLAUSES += [
    (f"regexp_matches(text, {_re(scoring.TOTAL_WITH_AMOUNT)})", 3, "total with amount"),
    ("regexp_matches(replace(lower(regexp_extract(file, '[^/]*$')), 'billion', '~'), 'invoice|receipt|bill')", 3, "filename"),
    ("pages > 30", -6, "pages>30"),
    ("pages > 10 AND pages <= 30", -3, "pages>10"),
]
_SCORED = f"""
scored AS MATERIALIZED (
    SELECT key, sha256, file, pages, ocr_pages, status, CASE WHEN status <> 'ok' THEN 0 ELSE {" + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in _CLAUSES)} END AS score,
        CASE WHEN status <> 'ok' THEN '' ELSE concat_ws(' ', {", ".join(f"CASE WHEN {c} THEN '{label}({w:+d})' END" for c, w, label in _CLAUSES)}) END AS reasons,
        status = 'ok' AND regexp_matches(text, {_re(scoring.SENSITIVE)}) AS sensitive
    FROM bills
),
classified AS MATERIALIZED (
    SELECT key, sha256, file, CASE WHEN status <> 'ok' THEN status WHEN score >= 8 THEN 'bill' WHEN score >= 4 THEN 'review' ELSE 'not_bill' END AS verdict,
        CAST(score AS INTEGER) AS score, pages, ocr_pages, sensitive, reasons FROM scored
)"""
_CLASSIFIED = f"WITH {sql_bills()}, {_SCORED}"

query("classification", f"{_CLASSIFIED} SELECT sha256, file, verdict, score, pages, ocr_pages, sensitive, reasons FROM classified")(_classified)
query("verdict_hist", f"{_CLASSIFIED} SELECT verdict, count(*) AS n, count(*) FILTER (sensitive) AS n_sensitive FROM classified GROUP BY verdict")(
    lambda s, d: scoring.histogram(_classified(s, d)))
query("rule_score_theta", f"""WITH {sql_bills()} SELECT sha256, CAST({" + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in _CLAUSES[: len(scoring.RULES)])} AS INTEGER) AS score FROM bills""")(
    lambda s, d: scoring.rule_hits(view.bills(s, d), scoring.rules_table(s), "sha256"))
query("filename_hint", f"WITH {sql_bills()} SELECT file, {_CLAUSES[-3][0]} AS hinted FROM bills")(
    lambda s, d: view.bills(s, d).select("file", scoring.basename(F.col("file")).rlike(scoring.FLAGS + scoring.FILENAME_HINT).alias("hinted")))
query("copy_targets", f"""{_CLASSIFIED}, named AS (SELECT CASE verdict WHEN 'bill' THEN 'Bills' ELSE 'Bills_Review' END AS target, regexp_extract(file, '[^/]*$') AS name, file, sha256 FROM classified WHERE verdict IN ('bill', 'review'))
SELECT target, name, file, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY target, name ORDER BY file, sha256) AS r FROM named) WHERE r = 1""")(
    lambda s, d: scoring.copy_targets(_classified(s, d)))
query("sensitive_documents", f"""SELECT doc_id, regexp_matches(text, {_re(scoring.SENSITIVE)}) AS sensitive, regexp_matches(text, {_re(scoring.TOTAL_WITH_AMOUNT)}) AS has_total FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.col("text").rlike(scoring.FLAGS + scoring.SENSITIVE).alias("sensitive"), F.col("text").rlike(scoring.FLAGS + scoring.TOTAL_WITH_AMOUNT).alias("has_total")))

# ---- text ----

query("normalize_numbers", f"""WITH {sql_bills()} SELECT key, replace(replace(replace(text, chr(10) || 'Subtotal ' || {view._sql_grouped("subtotal", 2)}, chr(10) || 'Subtotal ' || CAST(subtotal AS VARCHAR)),
    chr(10) || 'Tax ' || {view._sql_grouped("tax", 3)}, chr(10) || 'Tax ' || CAST(tax AS VARCHAR)), chr(10) || 'Grand Total ' || {view._sql_grouped("total", 2)}, chr(10) || 'Grand Total ' || CAST(total AS VARCHAR)) AS text FROM bills""")(
    lambda s, d: view.bills(s, d).select("key", text.normalize_numbers(F.col("text")).alias("text")))
query("truncate_text", f"""SELECT doc_id, CASE WHEN length(text) > {MAX_CHARS} THEN left(text, {HEAD_CHARS}) || chr(10) || '[...]' || chr(10) || right(text, {MAX_CHARS - HEAD_CHARS}) ELSE text END AS text FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("text")))
query("numbers_in", f"WITH {sql_bills()} SELECT key, array_to_string(list_transform(list_sort({sql_numbers('text')}), lambda x: CAST(x AS VARCHAR)), ' ') AS numbers FROM bills")(
    lambda s, d: view.bills(s, d).select("key", F.array_join(F.transform(F.array_sort(text.numbers_in(F.col("text"))), lambda x: x.cast("string")), " ").alias("numbers")))
query("document_numbers", f"SELECT doc_id, array_to_string(list_transform(list_sort({sql_numbers('text')}), lambda x: CAST(x AS VARCHAR)), ' ') AS numbers FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.transform(F.array_sort(text.numbers_in(F.col("text"))), lambda x: x.cast("string")), " ").alias("numbers")))
query("squash_norm", r"SELECT c_custkey, lower(regexp_replace(c_name, '[\s\-_/]', '', 'g')) AS squashed, regexp_replace(lower(c_mktsegment || ' ' || c_name), '[^a-z0-9]', '', 'g') AS normed FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", text.squash(F.col("c_name")).alias("squashed"), text.norm(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("normed")))
query("gstin_valid", f"""WITH {sql_bills()}, {sql_answers()} SELECT key, regexp_full_match(gstin, '{text.GSTIN}') AS valid FROM clean WHERE gstin IS NOT NULL""")(
    lambda s, d: _typed(s, d).where("gstin IS NOT NULL").select("key", text.valid_gstin(F.col("gstin")).alias("valid")))
query("date_valid", f"""WITH {sql_bills()}, {sql_labels()} SELECT key, regexp_full_match(invoice_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(invoice_date AS DATE) IS NOT NULL AS valid FROM labels0""")(
    lambda s, d: view.labels(view.bills(s, d)).select("key", text.valid_date(F.col("invoice_date")).alias("valid")))
query("amount_digits", f"WITH {sql_bills()} SELECT key, rtrim(rtrim(CAST(total AS VARCHAR), '0'), '.') AS digits FROM bills")(
    lambda s, d: view.bills(s, d).select("key", text.digits(F.col("total")).alias("digits")))
query("one_digit_apart", f"""WITH {sql_bills()}, p AS (SELECT key, rtrim(rtrim(CAST(subtotal AS VARCHAR), '0'), '.') AS a, rtrim(rtrim(CAST(total AS VARCHAR), '0'), '.') AS b FROM bills)
SELECT key, abs(length(a) - length(b)) = 1 AND levenshtein(a, b) = 1 AS apart FROM p""")(
    lambda s, d: view.bills(s, d).select("key", text.one_digit_apart(text.digits(F.col("subtotal")), text.digits(F.col("total"))).alias("apart")))
query("prompt", f"WITH {sql_bills()} SELECT key, 'DOCUMENT:' || chr(10) || CASE WHEN length(t) > {MAX_CHARS} THEN left(t, {HEAD_CHARS}) || chr(10) || '[...]' || chr(10) || right(t, {MAX_CHARS - HEAD_CHARS}) ELSE t END AS message FROM (SELECT key, regexp_replace(text, '(\\d),(\\d)', '\\1\\2', 'g') AS t FROM (SELECT key, regexp_replace(text, '(\\d),(\\d)', '\\1\\2', 'g') AS text FROM bills))")(
    lambda s, d: view.bills(s, d).select("key", text.user_message(text.prepare(F.col("text"))).alias("message")))

# ---- records ----

_CLEAN = f"WITH {sql_bills()}, {sql_answers()}"
query("parse_record", f"{_CLEAN} SELECT key, j IS NOT NULL AS valid, guided, json_type(j, '$.total') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS numeric_total FROM clean")(
    lambda s, d: view.answers(view.bills(s, d)).withColumn("o", record.parse_object(F.col("output"))).select(
        "key", F.col("o").isNotNull().alias("valid"), (F.col("o").isNull() | ~record.complete(F.col("output"))).alias("guided"), record.kind(F.col("o"), "total").rlike("^(DECIMAL|DOUBLE|BIGINT)").alias("numeric_total")))
query("clean_record", f"{_CLEAN} SELECT key, {', '.join(FIELDS)} FROM clean")(lambda s, d: _typed(s, d).select("key", *FIELDS))
query("props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(record.parse_object(F.col("props")), "$.k", "bigint").alias("k")))

_CHECKED = f"""{_CLEAN},
n0 AS (SELECT *, {sql_numbers("text")} AS numbers FROM clean WHERE status = 'ok'),
n1 AS (
    SELECT *, {", ".join(f"CASE WHEN {f} IS NOT NULL AND NOT list_contains(numbers, {f}) THEN list_filter(numbers, lambda n: abs(length(rtrim(rtrim(CAST(n AS VARCHAR), '0'), '.')) - length(rtrim(rtrim(CAST({f} AS VARCHAR), '0'), '.'))) = 1 AND levenshtein(rtrim(rtrim(CAST(n AS VARCHAR), '0'), '.'), rtrim(rtrim(CAST({f} AS VARCHAR), '0'), '.')) = 1) END AS near_{f}" for f in ("subtotal", "total"))}
    FROM n0
),
n2 AS (
    SELECT * EXCLUDE (subtotal, total), CASE WHEN len(near_subtotal) = 1 THEN near_subtotal[1] ELSE subtotal END AS subtotal, CASE WHEN len(near_total) = 1 THEN near_total[1] ELSE total END AS total,
        gstin IS NOT NULL AND gstin <> '' AND NOT regexp_full_match(trim(gstin), '{text.GSTIN}') AS bad FROM n1
),
n3 AS (SELECT *, coalesce(abs(subtotal + tax - total) > 1, false) AS wrong, coalesce(abs(subtotal + tax - total) > 1 AND total >= subtotal AND list_contains(numbers, subtotal) AND list_contains(numbers, total), false) AS derive FROM n2),
checked AS MATERIALIZED (
    SELECT key, sha256, file, guided, is_invoice, customer, vendor, invoice_number, invoice_date, currency, subtotal, CASE WHEN derive THEN CAST(total - subtotal AS DECIMAL(18,2)) ELSE tax END AS tax, total,
        CASE WHEN NOT bad THEN gstin END AS gstin, description, category,
        coalesce(nullif(concat_ws('; ', CASE WHEN len(near_subtotal) = 1 THEN 'subtotal snapped to printed amount' END, CASE WHEN len(near_total) = 1 THEN 'total snapped to printed amount' END, CASE WHEN bad THEN 'invalid gstin dropped' END,
            CASE WHEN total IS NULL THEN 'no total' WHEN NOT list_contains(numbers, total) THEN 'total not found in text' END, CASE WHEN derive THEN 'tax derived as total - subtotal' WHEN wrong THEN 'subtotal+tax != total' END), ''), 'ok') AS chk
    FROM n3
),
ledger AS MATERIALIZED (
    SELECT file, {", ".join(FIELDS)}, CASE WHEN NOT guided THEN chk WHEN chk = 'ok' THEN 'fields filled one at a time' ELSE 'fields filled one at a time; ' || chk END AS "check" FROM checked
    UNION ALL SELECT file, {", ".join("NULL" for _ in FIELDS)}, status FROM bills WHERE status <> 'ok'
)"""

query("snap_amounts", f"{_CHECKED} SELECT key, subtotal, total FROM n2")(
    lambda s, d: checks.snap_to_printed(_typed(s, d).where("status = 'ok'").withColumn("numbers", text.numbers_in(F.col("text")))).select("key", "subtotal", "total"))
query("check_record", f'{_CHECKED} SELECT key, {AMOUNTS}, gstin, chk AS "check" FROM checked')(
    lambda s, d: checks.check(_typed(s, d).where("status = 'ok'")).select("key", "subtotal", "tax", "total", "gstin", "check"))
query("ledger", f"{_CHECKED} SELECT * FROM ledger")(_ledger)
query("check_tally", f"""{_CHECKED} SELECT note, count(*) AS n FROM (SELECT unnest(string_split("check", '; ')) AS note FROM ledger) GROUP BY note""")(
    lambda s, d: _ledger(s, d).select(F.explode(F.split("check", "; ")).alias("note")).groupBy("note").agg(F.count("*").alias("n")))
_AMOUNT_JSON = "rtrim(rtrim(CAST({0} AS VARCHAR), '0'), '.')"
_JSON = ", ".join(f"coalesce({'CAST(' + f + ' AS VARCHAR)' if f == 'is_invoice' else _AMOUNT_JSON.format(f) if f in AMOUNT_FIELDS else 'CAST(to_json(' + f + ') AS VARCHAR)'}, 'null')" for f in FIELDS)
_TEMPLATE = "{{" + ",".join(f'"{f}":{{}}' for f in FIELDS) + "}}"
query("canonical_json", f"WITH {sql_bills()}, {sql_labels()} SELECT sha256, format('{_TEMPLATE}', {_JSON}) AS json FROM labels0")(
    lambda s, d: view.labels(view.bills(s, d)).select("sha256", record.to_json().alias("json")))

# ---- labels ----

_CAND = "NOT sensitive AND verdict NOT IN ('encrypted', 'unreadable')"
query("label_candidates", f"{_CLASSIFIED} SELECT sha256, file, verdict FROM classified WHERE {_CAND} AND verdict IN ('bill', 'review')")(
    lambda s, d: labels.candidates(_classified(s, d)).select("sha256", "file", "verdict"))
query("label_include_dir", f"{_CLASSIFIED} SELECT sha256, file, verdict FROM classified WHERE {_CAND} AND (verdict IN ('bill', 'review') OR file LIKE 'scan/%')")(
    lambda s, d: labels.candidates(_classified(s, d), "scan/").select("sha256", "file", "verdict"))
query("limit_candidates", f"{_CLASSIFIED} SELECT sha256, file, score FROM classified WHERE {_CAND} AND verdict IN ('bill', 'review') ORDER BY score DESC, file LIMIT 100")(
    lambda s, d: labels.first_candidates(labels.candidates(_classified(s, d)), 100).select("sha256", "file", "score"))
query("label_resume", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")(
    lambda s, d: labels.unlabelled(table(s, d, "documents").withColumnRenamed("doc_id", "sha256"), table(s, d, "labels").withColumnRenamed("doc_id", "sha256")).select(F.col("sha256").alias("doc_id")))
query("label_status", f"""{_CLASSIFIED} SELECT status, count(*) AS n FROM (SELECT CASE WHEN key % 4 = 0 THEN 'cached' WHEN key % 5 = 0 THEN 'FAILED' ELSE 'labelled' END AS status FROM classified WHERE {_CAND} AND verdict IN ('bill', 'review')) GROUP BY status""")(
    lambda s, d: _label_status(s, d).groupBy("status").agg(F.count("*").alias("n")))


def _corrections(s: SparkSession, d: str) -> DataFrame:
    keyed = view.bills(s, d).where("key % 12 = 0").select("sha256", "key")
    fixes = F.array(
        F.struct(F.lit("total").alias("field"), F.when(F.col("key") % 24 == 0, F.lit(None)).otherwise("99.5").alias("value")),
        F.struct(F.lit("vendor").alias("field"), F.concat(F.lit("Vendor "), F.col("key").cast("string")).alias("value")),
        F.struct(F.lit("vendor").alias("field"), F.lit("Another").alias("value")),
        F.struct(F.lit("_note").alias("field"), F.lit("x").alias("value")),
    )
    return keyed.select("sha256", F.explode(fixes).alias("x")).select("sha256", "x.field", "x.value")


query("corrections", f"""WITH {sql_bills()}, {sql_labels()} SELECT sha256, CASE WHEN key % 24 = 0 THEN NULL WHEN key % 12 = 0 THEN CAST(99.5 AS DECIMAL(18,2)) ELSE total END AS total,
    CASE WHEN key % 12 = 0 THEN 'Vendor ' || CAST(key AS VARCHAR) ELSE vendor END AS vendor, is_invoice FROM labels0""")(
    lambda s, d: labels.corrected(view.labels(view.bills(s, d)), _corrections(s, d)).select("sha256", "total", "vendor", "is_invoice"))

_AUDIT = f"""WITH {sql_bills()}, {sql_labels()},
audited AS MATERIALIZED (
    SELECT sha256, file, concat_ws('; ', CASE WHEN total IS NULL THEN 'no total' WHEN NOT list_contains({sql_numbers("text")}, total) THEN 'total not in text' END,
        CASE WHEN invoice_number <> '' AND NOT contains(lower(regexp_replace(text, '[\\s\\-_/]', '', 'g')), lower(regexp_replace(invoice_number, '[\\s\\-_/]', '', 'g'))) THEN 'invoice number not in text' END,
        CASE WHEN abs(subtotal + tax - total) > 1 THEN 'subtotal+tax != total' END,
        CASE WHEN NOT (regexp_full_match(invoice_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(invoice_date AS DATE) IS NOT NULL) THEN 'bad date' END,
        CASE WHEN NOT is_invoice THEN 'teacher says not an invoice' END) AS problems, {", ".join(FIELDS)} FROM labels0
)"""
query("audit_labels", f"{_AUDIT} SELECT sha256, file, problems, CASE WHEN problems = '' THEN 'auto' ELSE '' END AS approved FROM audited")(
    lambda s, d: _audited(s, d).select("sha256", "file", "problems", "approved"))
query("audit_tally", f"{_AUDIT} SELECT problem, count(*) AS n FROM (SELECT unnest(string_split(problems, '; ')) AS problem FROM audited WHERE problems <> '') GROUP BY problem")(
    lambda s, d: labels.tally(_audited(s, d)))
query("audit_counts", f"{_AUDIT} SELECT count(*) AS n_labels, count(*) FILTER (problems = '') AS n_clean, count(*) FILTER (problems <> '') AS n_flagged FROM audited")(
    lambda s, d: labels.audit_counts(_audited(s, d)))
_SHEET = ", ".join("CASE WHEN is_invoice THEN 'True' ELSE 'False' END AS is_invoice" if f == "is_invoice" else f"coalesce(CAST({f} AS VARCHAR), '') AS {f}" for f in FIELDS)
query("review_sheet", f"{_AUDIT} SELECT problems, CASE WHEN problems = '' THEN 'auto' ELSE '' END AS approved, file, {_SHEET}, sha256 FROM audited")(
    lambda s, d: labels.review_sheet(_audited(s, d)))
query("review_typed", f"{_AUDIT} SELECT sha256, {', '.join(FIELDS)} FROM audited")(
    lambda s, d: labels.typed_review(labels.review_sheet(_audited(s, d))).select("sha256", *FIELDS))

# ---- data sets ----

_KEY = "CASE WHEN coalesce(invoice_number, '') <> '' THEN CAST(to_json([coalesce(lower(vendor), 'none'), invoice_number, coalesce(CAST(total AS VARCHAR), 'none')]) AS VARCHAR) ELSE CAST(to_json([sha256]) AS VARCHAR) END"
_GROUPS = f"""WITH {sql_bills()}, {sql_labels()},
copies AS (SELECT * REPLACE (CASE WHEN key % 20 = 4 THEN 'b|c' WHEN key % 20 = 5 THEN 'c' WHEN key % 20 < 3 AND invoice_number IS NOT NULL THEN 'COPY-' || CAST(key // 60 AS VARCHAR) ELSE invoice_number END AS invoice_number,
    CASE WHEN key % 20 = 4 THEN 'a' WHEN key % 20 = 5 THEN 'a|b' WHEN key % 20 < 3 THEN 'Shared' ELSE vendor END AS vendor, CASE WHEN key % 20 < 3 THEN CAST(10 AS DECIMAL(18,2)) WHEN key % 20 < 6 THEN CAST(key // 2000 AS DECIMAL(18,2)) ELSE total END AS total) FROM labels0),
keyed AS MATERIALIZED (SELECT *, {_KEY} AS group_key FROM copies),
g AS (SELECT group_key, sha256('42|' || group_key) AS rank, count(*) AS n FROM keyed GROUP BY group_key),
t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rank, group_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 25 AS test FROM g),
v AS (SELECT *, NOT test AND coalesce(sum(n) OVER (PARTITION BY test ORDER BY rank, group_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 15 AS valid FROM t),
split AS MATERIALIZED (SELECT group_key, n, CASE WHEN test THEN 'test' WHEN valid THEN 'valid' ELSE 'train' END AS split FROM v)"""


def _copies(s: SparkSession, d: str) -> DataFrame:
    """Labels among which some bills occur more than once, and some have vendors and numbers that look alike when joined."""
    rows, some, place = view.labels(view.bills(s, d)), F.col("key") % 20 < 3, F.col("key") % 20
    number = F.when(place == 4, "b|c").when(place == 5, "c").when(some & F.col("invoice_number").isNotNull(), F.concat(F.lit("COPY-"), F.floor(F.col("key") / 60).cast("string"))).otherwise(F.col("invoice_number"))
    vendor = F.when(place == 4, "a").when(place == 5, "a|b").when(some, "Shared").otherwise(F.col("vendor"))
    total = F.when(some, F.lit(10).cast("decimal(18,2)")).when(place < 6, F.floor(F.col("key") / 2000).cast("decimal(18,2)")).otherwise(F.col("total"))
    return rows.withColumns({"invoice_number": number, "vendor": vendor, "total": total})


def _split(s: SparkSession, d: str) -> DataFrame:
    return dataset.quota_split(dataset.groups(_copies(s, d)))


query("invoice_groups", f"""{_GROUPS} SELECT coalesce(lower(vendor), 'none') AS vendor, invoice_number, total, count(*) AS n FROM copies WHERE coalesce(invoice_number, '') <> '' GROUP BY ALL
UNION ALL SELECT NULL, sha256, NULL, count(*) FROM copies WHERE coalesce(invoice_number, '') = '' GROUP BY sha256""")(
    lambda s, d: dataset.groups(_copies(s, d)).withColumn("k", F.from_json("group_key", "array<string>")).select(
        F.when(F.size("k") > 1, F.col("k")[0]).alias("vendor"), F.when(F.size("k") > 1, F.get("k", F.lit(1))).otherwise(F.col("k")[0]).alias("invoice_number"), F.get("k", F.lit(2)).try_cast("decimal(18,2)").alias("total"), "n"))
query("group_counts", f"{_GROUPS} SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g")(
    lambda s, d: dataset.groups(_copies(s, d)).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows")))
query("split_quota", f"{_GROUPS} SELECT group_key, rank, n, split FROM split JOIN (SELECT group_key, rank FROM g) USING (group_key)")(lambda s, d: _split(s, d).select("group_key", "rank", "n", "split"))
query("split_pinned", f"""{_GROUPS}, pin AS (SELECT DISTINCT group_key FROM keyed WHERE key % 500 = 1),
f AS (SELECT group_key, n, coalesce(sum(n) OVER (ORDER BY rank, group_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 15 AS valid FROM g WHERE group_key NOT IN (SELECT group_key FROM pin))
SELECT group_key, CASE WHEN valid THEN 'valid' ELSE 'train' END AS split FROM f UNION ALL SELECT group_key, 'test' FROM pin""")(
    lambda s, d: dataset.quota_split(dataset.groups(_copies(s, d)), pinned=_copies(s, d).where("key % 500 = 1").select(dataset.group_key().alias("group_key"))).select("group_key", "split"))
query("split_counts", f"{_GROUPS} SELECT split, CAST(sum(n) AS BIGINT) AS n FROM split GROUP BY split")(
    lambda s, d: _split(s, d).groupBy("split").agg(F.sum("n").alias("n")))
query("vendor_cap", f"""{_GROUPS}, a AS (SELECT k.sha256, split, coalesce(lower(vendor), 'none') AS ven, k.group_key, rank FROM keyed k JOIN split USING (group_key) JOIN (SELECT group_key, rank FROM g) USING (group_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY split, ven ORDER BY rank, group_key, sha256) AS r FROM a) SELECT sha256, split FROM r WHERE split <> 'train' OR r <= 16""")(
    lambda s, d: dataset.cap_vendors(dataset.split_rows(_copies(s, d))).select("sha256", "split"))
query("chat_examples", f"""{_GROUPS} SELECT k.sha256, split, CAST(3 AS INTEGER) AS n_messages, 'user' AS role, 'DOCUMENT:' || chr(10) || b.text AS request,
    k.vendor AS vendor, k.category AS category, CASE WHEN k.is_invoice THEN 'true' ELSE 'false' END AS is_invoice, k.invoice_number AS invoice_number FROM keyed k JOIN split USING (group_key) JOIN bills b ON b.sha256 = k.sha256""")(
    lambda s, d: dataset.chat(dataset.split_rows(_copies(s, d)).drop("text"), view.bills(s, d).select("sha256", "text")).select(
        "sha256", "split", F.size("messages").alias("n_messages"), F.element_at(dataset.request(F.col("messages")), -1)["role"].alias("role"), F.element_at(dataset.request(F.col("messages")), -1)["content"].alias("request"),
        *(F.get_json_object(dataset.expected(F.col("messages")), f"$.{f}").alias(f) for f in ("vendor", "category", "is_invoice", "invoice_number"))))
query("last_turn", "SELECT conv_id, count(*) AS n_turns, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")(
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max_by("text", "turn").alias("last_text")))

# ---- evaluation ----


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Both models' answers next to what is wanted, in one row of a bill, and then a row for each."""
    seconds = (F.col("key") % 7 + 1).cast("double")
    answer = lambda model, output, took: F.struct(F.lit(model).alias("model"), output.alias("output"), took.alias("seconds"))
    both = F.array(answer("tuned", F.col("output"), seconds), answer("base", F.replace("output", F.lit('"INV/'), F.lit('"INV/9')), seconds * 2))
    rows = view.answers(view.bills(s, d)).select(F.col("sha256").alias("doc_id"), F.explode(both).alias("x"), *SCORED)
    return rows.select("doc_id", "x.*", *SCORED)


def _totals(s: SparkSession, d: str) -> DataFrame:
    return evaluation.totals(_answers(s, d))


_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def _sql_correct(f: str) -> str:
    if f in ("subtotal", "tax", "total"):
        return f"(CASE WHEN {f} IS NULL THEN false ELSE abs({f} - t_{f}) <= 0.01 END)"
    got, want = _NORM.format(f"coalesce(j->>'$.{f}', '')"), _NORM.format(f"CAST(t_{f} AS VARCHAR)")
    return f"(contains({got}, {want}) OR contains({want}, {got}))" if f == "vendor" else f"({got} = {want})"


_JUDGED = f"""{_CLEAN},
two AS (SELECT *, 'tuned' AS model, key % 7 + 1.0 AS seconds FROM clean UNION ALL SELECT *, 'base' AS model, (key % 7 + 1.0) * 2 AS seconds FROM clean),
judged AS MATERIALIZED (
    SELECT sha256 AS doc_id, model, seconds, j IS NOT NULL AS valid, output, {", ".join(f"j IS NOT NULL AND {_sql_correct(f)}" + (" AND model = 'tuned'" if f == "invoice_number" else "") + f" AS c_{f}" for f in SCORED)} FROM two
)"""
query("field_accuracy", f"{_JUDGED} {' UNION ALL '.join(f"SELECT model, '{f}' AS field, count(*) AS n, count(*) FILTER (c_{f}) AS n_correct FROM judged GROUP BY model" for f in SCORED)}")(
    lambda s, d: evaluation.accuracy_of(_totals(s, d)))
query("document_scores", f"{_JUDGED} SELECT model, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND {' AND '.join(f'c_{f}' for f in SCORED)}) AS n_exact, avg(CAST(seconds AS DOUBLE)) AS mean_seconds FROM judged GROUP BY model")(
    lambda s, d: _totals(s, d).drop("right"))
query("misses", f"{_JUDGED} {' UNION ALL '.join(f"SELECT model, '{f}' AS field, count(*) AS n FROM judged WHERE valid AND NOT c_{f} GROUP BY model" for f in SCORED)} UNION ALL SELECT model, 'invalid json', count(*) FROM judged WHERE NOT valid GROUP BY model")(
    lambda s, d: evaluation.misses_of(_totals(s, d)))
query("model_pivot", f"{_JUDGED} {' UNION ALL '.join(f"SELECT '{f}' AS field, CAST((count(*) FILTER (c_{f} AND model = 'base')) * 1000 // (count(*) FILTER (model = 'base')) AS BIGINT) AS base, CAST((count(*) FILTER (c_{f} AND model = 'tuned')) * 1000 // (count(*) FILTER (model = 'tuned')) AS BIGINT) AS tuned FROM judged" for f in SCORED)}")(
    lambda s, d: evaluation.head_to_head(evaluation.accuracy_of(_totals(s, d)), ["base", "tuned"]))

# ---- reports ----

query("spend_by_vendor", f"{_CHECKED} SELECT vendor, currency, CAST(sum(total) AS DECIMAL(38,2)) AS spend, count(*) AS n_bills FROM ledger WHERE is_invoice AND total IS NOT NULL GROUP BY vendor, currency")(
    lambda s, d: reports.spend_by_vendor(_ledger(s, d)))
query("addressed_to", f"{_CHECKED} SELECT file, customer, total FROM ledger WHERE lower(customer) LIKE '%1%'")(
    lambda s, d: reports.addressed_to(_ledger(s, d), "1").select("file", "customer", "total"))
query("dedup_bills", f"""{_GROUPS} SELECT file, vendor, invoice_number, total FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(lower(vendor), 'none'), coalesce(nullif(invoice_number, ''), file), total ORDER BY file) AS r FROM keyed) WHERE r = 1""")(
    lambda s, d: reports.dedup_bills(_copies(s, d).select("file", "vendor", "invoice_number", "total")))
