"""Keyword scoring of documents and verdicts."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.schema import BILL_THRESHOLD, REVIEW_THRESHOLD
from paperledger.tables import once

# ---- Fixed values: rules (pattern, weight, label), each counted once; other patterns and weights. ----
POSITIVE = [
    (r"\btax invoice\b", 4, "tax invoice"),
    (r"\bbill of supply\b", 4, "bill of supply"),
    (r"\binvoice\b", 3, "invoice"),
    (r"\breceipt\b", 3, "receipt"),
    (r"\b(invoice|bill|receipt)\s*(no\.?|number|#|id)\b", 4, "invoice number"),
    (r"\bamount (due|payable)\b", 3, "amount due"),
    (r"\bgrand total\b", 3, "grand total"),
    (r"\btotal amount\b", 2, "total amount"),
    (r"\bsub\s?-?total\b", 2, "subtotal"),
    (r"\bgstin\b", 2, "gstin"),
    (r"\b(hsn|sac)\b", 2, "hsn/sac"),
    (r"\b(cgst|sgst|igst|utgst)\b", 2, "gst split"),
    (r"\b(amount paid|payment received|paid on)\b", 2, "payment"),
    (r"\b(billing|bill) (period|date|cycle)\b", 2, "billing period"),
    (r"\bdue date\b", 1, "due date"),
    (r"\border (id|no\.?|number|#)\b", 1, "order id"),
    (r"\bchallan\b", 2, "challan"),
    (r"\b(ending|closing|outstanding) balance\b", 2, "balance"),
]
NEGATIVE = [
    (r"\babstract\b", -2, "abstract"),
    (r"\bchapter\b", -2, "chapter"),
    (r"\btable of contents\b", -3, "table of contents"),
    (r"\breferences\b", -1, "references"),
    (r"\b(pay ?slip|salary slip|earnings|deductions)\b", -4, "payslip"),
    (r"\b(examination report|trade ?mark|registration certificate)\b", -3, "legal"),
    (r"\b(balance sheet|profit (and|&) loss)\b", -3, "financials"),
]
TOTAL_WITH_AMOUNT = r"(grand total|total amount|amount due|amount payable|total due|\btotal\b)[^\n]{0,40}?(₹|rs\.?|inr|\$|usd|€|eur)?\s*\d[\d,]*\.\d{2}"
FILENAME_HINT = r"invoice|receipt|bill(?!ion)"
SENSITIVE = r"annual information statement|form 26as|statement of account|account statement|bank statement|aadhaar|passport|credit card statement|card statement"
MANY_PAGES = [(30, -6), (10, -3)]
EXTRA = 3

FLAGS = "(?iuU)"
RULES = POSITIVE + NEGATIVE


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _simple(pattern: str) -> bool:
    """Whether Python reads a pattern as Java does, and ASCII text meets it alike with and without Unicode's rules."""
    return not re.search(r"\\[^bsdwBSDWnrt\W]|\(\?[^:!]|\[[^\]]*[\[&]|[*+?}]\+", pattern) and all(c.isascii() or not c.isalpha() for c in pattern)


def needed(pattern: str) -> list[str]:
    """Lower-case texts one of which is in all ASCII text that meets a pattern without regard to case; none if unknown."""

    def of(items) -> list[str]:
        runs, run = [], ""
        for kind, value in [*items, (None, None)]:
            name = str(kind)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            if name in ("AT", "ASSERT_NOT"):
                continue
            runs.append([run])
            run = ""
            if name == "SUBPATTERN":
                runs.append(of(value[3]))
            elif name == "BRANCH":
                each = [of(x) for x in value[1]]
                runs.append([w for x in each for w in x] if all(each) else [])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
                runs.append(of(value[2]))
        return max((x for x in runs if all(x)), key=lambda x: min(map(len, x), default=0), default=[])

    try:
        return list(dict.fromkeys(of(_parser.parse(pattern)))) if _simple(pattern) else []
    except re.error:
        return []


def meets(text: Column, pattern: str, plain: Column, low: Column) -> Column:
    """Whether a text meets a pattern, without regard to case and by Unicode's rules. plain: whether the text is ASCII;
    then it is first looked up whether what the pattern can't do without is in ``low``, the text in lower case."""
    full = text.rlike(FLAGS + pattern)
    if not _simple(pattern):
        return full
    short = text.rlike("(?i)" + pattern)
    if words := needed(pattern):
        short = reduce(lambda x, y: x | y, (low.contains(w) for w in words)) & short
    return F.when(plain, short).otherwise(full)


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


#: Weights and labels of all that can speak for or against a bill, in the order of reasons.
FINDINGS = [(w, label) for _, w, label in RULES] + [(EXTRA, "total with amount"), (EXTRA, "filename")] + [(w, f"pages>{n}") for n, w in MANY_PAGES]


#: So many are looked up by one generated method; one of over 8,000 bytes isn't compiled by the JVM.
AT_ONCE = 8


def findings(text: Column, path: Column, pages: Column, plain: Column, low: Column) -> list[Column]:
    """Whether each of ``FINDINGS`` speaks for or against a bill."""
    name = basename(path)
    found = [meets(text, p, plain, low) for p in [*(p for p, _, _ in RULES), TOTAL_WITH_AMOUNT]]
    found.append(meets(name, FILENAME_HINT, is_ascii(name), F.lower(name)))
    most = None
    for limit, _ in MANY_PAGES:
        found.append((pages > limit) if most is None else (pages > limit) & (pages <= most))
        most = limit
    return found


def _bits(hits: list[tuple[int, Column]]) -> Column:
    """A number with these bits."""
    return reduce(lambda x, y: x + y, (F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)) for i, hit in hits)).cast("long")


def _has(found: Column, i: int) -> Column:
    return found.bitwiseAND(F.lit(1 << i)) != 0


def score(found: Column) -> Column:
    return reduce(lambda x, y: x + y, (F.when(_has(found, i), F.lit(w)).otherwise(F.lit(0)) for i, (w, _) in enumerate(FINDINGS)))


def reasons(found: Column) -> Column:
    return F.concat_ws(" ", *(F.when(_has(found, i), f"{label}({w:+d})") for i, (w, label) in enumerate(FINDINGS)))


def verdict(status: Column, points: Column) -> Column:
    return F.when(status != "ok", status).when(points >= BILL_THRESHOLD, "bill").when(points >= REVIEW_THRESHOLD, "review").otherwise("not_bill")


def classify(extracted: DataFrame) -> DataFrame:
    """(sha256, file, verdict, score, pages, ocr_pages, sensitive, reasons) of rows with
    (sha256, file, text, page_count, ocr_pages, status). Rows that aren't ok have no score, reasons or flag."""
    ok, text, plain, low = F.col("status") == "ok", F.col("text"), F.col("_plain"), F.col("_low")
    rows = extracted.withColumns({"_plain": is_ascii(text), "_low": F.lower(text)})
    rows = once(rows, sensitive=ok & meets(text, SENSITIVE, plain, low))
    found, parts = list(enumerate(findings(text, F.col("file"), F.col("page_count"), plain, low))), []
    for i in range(0, len(found), AT_ONCE):
        parts.append(f"_found{i}")
        rows = once(rows, **{parts[-1]: F.when(ok, _bits(found[i : i + AT_ONCE])).otherwise(F.lit(0))})
    found = reduce(lambda x, y: x + y, map(F.col, parts)).alias("_found")
    scored = once(rows.select("sha256", "file", "status", "page_count", "ocr_pages", "sensitive", found), score=score(F.col("_found")))
    return scored.select(
        "sha256", "file", verdict(F.col("status"), F.col("score")).alias("verdict"), "score", F.col("page_count").alias("pages"), "ocr_pages",
        "sensitive", reasons(F.col("_found")).alias("reasons"),
    )


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, w, label, i) for i, (p, w, label) in enumerate(RULES)], "pattern string, weight int, label string, ord int")


def rule_hits(texts: DataFrame, rules: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, score) of texts by a table of rules, for rules that are data. Texts without hits have 0.

    The rules become a part of the plan, as those of ``findings`` are: each pattern is compiled once, and no text is
    paired with rules or shuffled but to add up texts of one key. A rule that is null in any part never applies.
    """
    found = rules.where("pattern IS NOT NULL AND weight IS NOT NULL").select("pattern", "weight").collect()
    rows = texts.select(key, F.col(text_col).alias("_text")).withColumns({"_plain": is_ascii(F.col("_text")), "_low": F.lower("_text")})
    points = (F.when(meets(F.col("_text"), r["pattern"], F.col("_plain"), F.col("_low")), F.lit(r["weight"])).otherwise(F.lit(0)) for r in found)
    each = rows.select(key, reduce(lambda x, y: x + y, points, F.lit(0)).alias("score"))
    return each.groupBy(key).agg(F.sum("score").cast("int").alias("score"))


def histogram(classified: DataFrame) -> DataFrame:
    """(verdict, n, n_sensitive), by verdict."""
    return classified.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("sensitive")).alias("n_sensitive")).orderBy("verdict")


def report_order(classified: DataFrame) -> DataFrame:
    return classified.orderBy(F.desc("score"), "file")


def copy_targets(classified: DataFrame) -> DataFrame:
    """(target, name, file, sha256): what goes to the folders of bills and of reviews; of one name the first file only."""
    target = F.when(F.col("verdict") == "bill", "Bills").when(F.col("verdict") == "review", "Bills_Review")
    named = classified.withColumn("target", target).where("target IS NOT NULL").withColumn("name", basename(F.col("file")))
    return named.groupBy("target", "name").agg(F.min_by(F.struct("file", "sha256"), F.struct("file", "sha256")).alias("first")).select("target", "name", "first.file", "first.sha256")
