"""A deterministic view of bills, answers and labels over the order tables, in Spark and in SQL.

Each order with lines is a bill. Titles, pages, extra lines and faults of the answers follow the order's
number, so that every rule and every check message occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.functions.record import to_json
from paperledger.schema import CATEGORIES, FIELDS

TITLES = ["TAX INVOICE", "INVOICE", "RECEIPT", "BILL OF SUPPLY", "QUOTATION", "Statement of Account"]
NAMES = ["scan/invoice-", "mail/receipt_", "billion/", "misc/doc", "mail/Bill", "scan/"]
EXTRAS = ["", "HSN 998313", "Balance Sheet", "Abstract\nChapter 1\nReferences", "Order ID: 7", "Due date: soon", "CGST and SGST", "Salary slip", "Amount paid", "Billing period", "Challan", "Closing balance", "Table of contents"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def lakh(amount: Column) -> Column:
    """12,34,567.89"""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"(\d)(?=(?:\d\d)+\d\.)", "$1,")


def western(amount: Column) -> Column:
    """1,234,567.89"""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"(\d)(?=(?:\d{3})+\.)", "$1,")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, sha256, file, pages, ocr_pages, status, text, fields): what is true of each bill, and its text.

    The lines are added up by order before any join, on the key that the join with orders needs.
    """
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum(price).cast("decimal(18,2)").alias("subtotal"), F.round(F.sum(price * F.col("l_tax").cast("decimal(4,2)")), 2).cast("decimal(18,2)").alias("tax"), F.min("l_suppkey").alias("s_suppkey")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"))
    joined = orders.join(lines, "key").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer")), "c_custkey")
    joined = joined.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("vendor")), "s_suppkey")
    key = F.col("key")
    full = joined.select(
        "key", F.concat(pick(NAMES, key), key.cast("string"), F.lit(".pdf")).alias("file"),
        F.when(key % 41 == 0, 35).when(key % 43 == 0, 12).otherwise(1).cast("int").alias("pages"), F.lit(0).alias("ocr_pages"),
        F.when(key % 47 == 0, "encrypted").when(key % 53 == 0, "unreadable").otherwise("ok").alias("status"),
        (key % 6 < 4).alias("is_invoice"), "customer", "vendor", F.concat(F.lit("INV/"), key.cast("string")).alias("invoice_number"), "invoice_date",
        F.when(key % 3 == 0, "USD").otherwise("INR").alias("currency"), "subtotal", "tax", (F.col("subtotal") + F.col("tax")).cast("decimal(18,2)").alias("total"),
        F.concat(F.lpad((key % 37).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("F1Z5")).alias("gstin"),
        F.concat(F.lit("order "), key.cast("string")).alias("description"), pick(CATEGORIES, key).alias("category"),
    )
    text = F.concat_ws(
        "\n", F.concat(F.lit("--- page 1 ---")), pick(TITLES, key), "vendor", F.concat(F.lit("GSTIN: "), "gstin"), F.concat(F.lit("Invoice No: "), "invoice_number"), F.concat(F.lit("Date: "), "invoice_date"),
        F.concat(F.lit("Bill To: "), "customer"), pick(EXTRAS, key), F.concat(F.lit("Subtotal "), lakh(F.col("subtotal"))), F.concat(F.lit("Tax "), western(F.col("tax"))), F.concat(F.lit("Grand Total "), lakh(F.col("total"))),
    )
    return full.withColumn("text", text).withColumn("sha256", F.sha2(F.concat_ws("|", F.col("key").cast("string"), "text").cast("binary"), 256))


def answers(rows: DataFrame) -> DataFrame:
    """The bills with ``output``: a simulated model's answer, with faults."""
    key = F.col("key")
    plain = F.col("subtotal").cast("string")
    half = (F.col("tax") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(18,2)")
    fields = [
        F.when(key % 31 == 0, '"yes"').otherwise(F.col("is_invoice").cast("string")),
        F.concat(F.lit('"'), "customer", F.lit('"')), F.concat(F.lit('"'), F.when(key % 59 == 0, F.concat(F.lower("vendor"), F.lit(" Ltd"))).otherwise(F.col("vendor")), F.lit('"')),
        F.concat(F.lit('"'), "invoice_number", F.lit('"')), F.concat(F.lit('"'), "invoice_date", F.lit('"')), F.concat(F.lit('"'), F.lower("currency"), F.lit('"')),
        F.when(key % 7 == 0, F.concat(F.substring(plain, 1, 1), F.substring(plain, 3, 30))).when(key % 29 == 0, F.concat(F.lit('"Rs '), western(F.col("subtotal")), F.lit('"'))).otherwise(plain),
        F.when(key % 5 == 0, half.cast("string")).otherwise(F.col("tax").cast("string")),
        F.when(key % 13 == 0, "null").when(key % 17 == 0, (F.col("total") + 1000).cast("string")).when(key % 61 == 0, '"n/a"').otherwise(F.col("total").cast("string")),
        F.concat(F.lit('"'), F.when(key % 11 == 0, "BADGSTIN").otherwise(F.col("gstin")), F.lit('"')), F.concat(F.lit('"'), "description", F.lit('"')),
        F.concat(F.lit('"'), F.when(key % 37 == 0, "Groceries").otherwise(F.col("category")), F.lit('"')),
    ]
    pairs = [F.concat(F.lit(f'"{name}": '), value) for name, value in zip(FIELDS, fields, strict=True) if name != "description"]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.when(key % 23 == 0, "").otherwise(F.concat(F.lit(", "), F.lit('"description": '), fields[10])))
    return rows.withColumn("output", F.concat(F.when(key % 67 == 0, "Here it is: ").otherwise(""), body, F.when(key % 19 == 0, "").otherwise("}"), F.when(key % 67 == 0, " done").otherwise("")))


def labels(rows: DataFrame) -> DataFrame:
    """Labels of bills, with faults for the audit."""
    key = F.col("key")
    return rows.select(
        "sha256", "key", "file", "text", F.when(key % 10 == 0, F.lit(False)).otherwise(F.col("is_invoice")).alias("is_invoice"), "customer", "vendor",
        F.when(key % 9 == 0, "X-1").when(key % 14 == 0, F.lit(None)).otherwise(F.replace("invoice_number", F.lit("/"), F.lit(" "))).alias("invoice_number"),
        F.when(key % 8 == 0, "2026-02-30").when(key % 21 == 0, "2026-9-5").otherwise(F.col("invoice_date")).alias("invoice_date"), "currency", "subtotal",
        F.when(key % 6 == 0, (F.col("tax") + 5).cast("decimal(18,2)")).otherwise(F.col("tax")).alias("tax"),
        F.when(key % 15 == 0, F.lit(None)).when(key % 22 == 0, (F.col("total") + 500).cast("decimal(18,2)")).otherwise(F.col("total")).alias("total"), "gstin", "description", "category",
    )


def canonical(rows: DataFrame) -> DataFrame:
    return rows.select("key", to_json().alias("json"))


def _sql_pick(values: list[str], number: str = "key") -> str:
    return "list_extract([" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + f"], CAST({number} % {len(values)} + 1 AS INTEGER))"


def _sql_grouped(amount: str, step: int) -> str:
    """Groups the digits above the last three by ``step``, counted from the right."""
    text = f"CAST(CAST({amount} AS DECIMAL(18,2)) AS VARCHAR)"
    head, cents = f"left({text}, length({text}) - 6)", f"right({text}, 6)"
    grouped = f"ltrim(reverse(regexp_replace(reverse({head}), '(\\d{{{step}}})', '\\1,', 'g')), ',')"
    return f"(CASE WHEN length({text}) <= 6 THEN {text} ELSE {grouped} || ',' || {cents} END)"


def sql_bills() -> str:
    return f"""
lines AS (
    SELECT l_orderkey AS key, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS subtotal,
        CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS tax, min(l_suppkey) AS s_suppkey
    FROM lineitem GROUP BY l_orderkey
),
facts AS (
    SELECT key, {_sql_pick(NAMES)} || CAST(key AS VARCHAR) || '.pdf' AS file, CAST(CASE WHEN key % 41 = 0 THEN 35 WHEN key % 43 = 0 THEN 12 ELSE 1 END AS INTEGER) AS pages, 0 AS ocr_pages,
        CASE WHEN key % 47 = 0 THEN 'encrypted' WHEN key % 53 = 0 THEN 'unreadable' ELSE 'ok' END AS status, key % 6 < 4 AS is_invoice, c_name AS customer, s_name AS vendor,
        'INV/' || CAST(key AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CASE WHEN key % 3 = 0 THEN 'USD' ELSE 'INR' END AS currency,
        subtotal, tax, CAST(subtotal + tax AS DECIMAL(18,2)) AS total, lpad(CAST(key % 37 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(key % 10000 AS VARCHAR), 4, '0') || 'F1Z5' AS gstin,
        'order ' || CAST(key AS VARCHAR) AS description, {_sql_pick(CATEGORIES)} AS category
    FROM orders JOIN lines ON key = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier USING (s_suppkey)
),
texts AS (
    SELECT *, '--- page 1 ---' || chr(10) || {_sql_pick(TITLES)} || chr(10) || vendor || chr(10) || 'GSTIN: ' || gstin || chr(10) || 'Invoice No: ' || invoice_number || chr(10) || 'Date: ' || invoice_date
        || chr(10) || 'Bill To: ' || customer || chr(10) || {_sql_pick(EXTRAS)} || chr(10) || 'Subtotal ' || {_sql_grouped("subtotal", 2)} || chr(10) || 'Tax ' || {_sql_grouped("tax", 3)}
        || chr(10) || 'Grand Total ' || {_sql_grouped("total", 2)} AS text
    FROM facts
),
bills AS MATERIALIZED (SELECT *, sha256(CAST(key AS VARCHAR) || '|' || text) AS sha256 FROM texts)"""


def sql_answers() -> str:
    plain = "CAST(subtotal AS VARCHAR)"
    fields = {
        "is_invoice": "CASE WHEN key % 31 = 0 THEN '\"yes\"' WHEN is_invoice THEN 'true' ELSE 'false' END",
        "customer": "'\"' || customer || '\"'",
        "vendor": "'\"' || CASE WHEN key % 59 = 0 THEN lower(vendor) || ' Ltd' ELSE vendor END || '\"'",
        "invoice_number": "'\"' || invoice_number || '\"'",
        "invoice_date": "'\"' || invoice_date || '\"'",
        "currency": "'\"' || lower(currency) || '\"'",
        "subtotal": f"CASE WHEN key % 7 = 0 THEN left({plain}, 1) || substr({plain}, 3) WHEN key % 29 = 0 THEN '\"Rs ' || {_sql_grouped('subtotal', 3)} || '\"' ELSE {plain} END",
        "tax": "CASE WHEN key % 5 = 0 THEN CAST(CAST(tax * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(tax AS VARCHAR) END",
        "total": "CASE WHEN key % 13 = 0 THEN 'null' WHEN key % 17 = 0 THEN CAST(CAST(total + 1000 AS DECIMAL(18,2)) AS VARCHAR) WHEN key % 61 = 0 THEN '\"n/a\"' ELSE CAST(total AS VARCHAR) END",
        "gstin": "'\"' || CASE WHEN key % 11 = 0 THEN 'BADGSTIN' ELSE gstin END || '\"'",
        "category": "'\"' || CASE WHEN key % 37 = 0 THEN 'Groceries' ELSE category END || '\"'",
    }
    body = " || ', ' || ".join(f"'\"{k}\": ' || {v}" for k, v in fields.items())
    return f"""
answers AS MATERIALIZED (
    SELECT *, CASE WHEN key % 67 = 0 THEN 'Here it is: ' ELSE '' END || '{{' || {body} || CASE WHEN key % 23 = 0 THEN '' ELSE ', "description": "' || description || '"' END
        || CASE WHEN key % 19 = 0 THEN '' ELSE '}}' END || CASE WHEN key % 67 = 0 THEN ' done' ELSE '' END AS output
    FROM bills
),
objects AS MATERIALIZED (
    SELECT *, CASE WHEN json_valid(o) AND o <> '' THEN o END AS j FROM (SELECT *, regexp_extract(output, '(?s)\\{{.*\\}}', 0) AS o FROM answers)
),
amounts AS (
    SELECT *, {", ".join(f"CASE json_type(j, '$.{f}') WHEN 'VARCHAR' THEN TRY_CAST(regexp_replace(j->>'$.{f}', '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2)) WHEN 'BOOLEAN' THEN NULL ELSE TRY_CAST(j->>'$.{f}' AS DECIMAL(18,2)) END AS a_{f}" for f in ("subtotal", "tax", "total"))}
    FROM objects
),
clean AS MATERIALIZED (
    SELECT key, sha256, file, status, text, output, j, j IS NULL OR NOT json_exists(j, '$.description') AS guided, is_invoice AS t_is_invoice,
        customer AS t_customer, vendor AS t_vendor, invoice_number AS t_invoice_number, invoice_date AS t_invoice_date, currency AS t_currency, subtotal AS t_subtotal, tax AS t_tax, total AS t_total, gstin AS t_gstin, category AS t_category,
        CASE WHEN json_type(j, '$.is_invoice') = 'BOOLEAN' THEN CAST(j->>'$.is_invoice' AS BOOLEAN) END AS is_invoice, j->>'$.customer' AS customer, j->>'$.vendor' AS vendor,
        j->>'$.invoice_number' AS invoice_number, j->>'$.invoice_date' AS invoice_date, j->>'$.currency' AS currency, a_subtotal AS subtotal, a_tax AS tax, a_total AS total, j->>'$.gstin' AS gstin,
        j->>'$.description' AS description, CASE WHEN j->>'$.category' IN ({", ".join("'" + c + "'" for c in CATEGORIES)}) THEN j->>'$.category' END AS category
    FROM amounts
)"""


def sql_numbers(text: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda m: TRY_CAST(replace(m, ',', '') AS DECIMAL(18,2))), lambda x: x IS NOT NULL))"


def sql_labels() -> str:
    return """
labels0 AS (
    SELECT sha256, key, file, text, CASE WHEN key % 10 = 0 THEN false ELSE is_invoice END AS is_invoice, customer, vendor,
        CASE WHEN key % 9 = 0 THEN 'X-1' WHEN key % 14 = 0 THEN NULL ELSE replace(invoice_number, '/', ' ') END AS invoice_number,
        CASE WHEN key % 8 = 0 THEN '2026-02-30' WHEN key % 21 = 0 THEN '2026-9-5' ELSE invoice_date END AS invoice_date, currency, subtotal,
        CASE WHEN key % 6 = 0 THEN CAST(tax + 5 AS DECIMAL(18,2)) ELSE tax END AS tax,
        CASE WHEN key % 15 = 0 THEN NULL WHEN key % 22 = 0 THEN CAST(total + 500 AS DECIMAL(18,2)) ELSE total END AS total, gstin, description, category
    FROM bills
)"""
