"""Rules, checks, audit, splits and scores on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperledger.functions import record
from paperledger.operators import checks, dataset, evaluation, labels, reports, scoring
from paperledger.schema import FIELDS

D = Decimal
EXTRACTED = "sha256 string, file string, text string, page_count int, ocr_pages int, status string"


def classify(spark, *rows):
    return {r.file: r for r in scoring.classify(spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], EXTRACTED)).collect()}


def test_scores_reasons_and_verdicts(spark):
    got = classify(
        spark,
        ("a/sample_invoice.pdf", "TAX INVOICE\nInvoice No: 7\nGrand Total ₹ 1,47,500.00", 1, 0, "ok"),
        ("a/x.pdf", "Abstract. Chapter 2. References", 31, 0, "ok"),
        ("a/y.pdf", "receipt for you", 11, 0, "ok"),
        ("a/z.pdf", "receipt from my bank statement, sub total", 1, 0, "ok"),
        ("a/e.pdf", "invoice", 1, 0, "encrypted"),
    )
    row = got["a/sample_invoice.pdf"]
    assert (row.score, row.verdict, row.sensitive) == (20, "bill", False)
    assert row.reasons == "tax invoice(+4) invoice(+3) invoice number(+4) grand total(+3) total with amount(+3) filename(+3)"
    assert (got["a/x.pdf"].score, got["a/x.pdf"].verdict) == (-11, "not_bill")
    assert (got["a/y.pdf"].score, got["a/y.pdf"].reasons) == (0, "receipt(+3) pages>10(-3)")
    assert (got["a/z.pdf"].score, got["a/z.pdf"].verdict, got["a/z.pdf"].sensitive) == (5, "review", True)
    assert (got["a/e.pdf"].score, got["a/e.pdf"].verdict, got["a/e.pdf"].reasons, got["a/e.pdf"].sensitive) == (0, "encrypted", "", False)


@pytest.mark.parametrize("name, wanted", [("billion.pdf", False), ("billing.pdf", True), ("MyBill.pdf", True), ("billionbill.pdf", True), ("x.pdf", False), ("bill/x.pdf", False)])
def test_filename_hint(spark, name, wanted):
    assert spark.range(1).select(scoring.basename(F.lit(name)).rlike(scoring.FLAGS + scoring.FILENAME_HINT)).first()[0] is wanted


ODD = ["Taxſ INVOICE", "ınvoıce no 5", "İNVOİCE", "challan\u2060", "paſſport", "sub\u00a0total", "sub-total", "Total ₹ १२.३४", "TOTAL due:  Rs. 12.50", "total 1,2.34x", "xchallan", "challané", "pay slip", "Profit & Loss", "order #", "Order no.", "bill\t#", None, ""]


def test_texts_meet_patterns_as_by_the_patterns_alone(spark):
    texts = spark.createDataFrame([(x,) for x in [*ODD, *(f"a {x}\nsalary slip 7.00" for x in ODD if x)]], "t string")
    t, low = F.col("t"), F.lower("t")
    patterns = [*(p for p, _, _ in scoring.RULES), scoring.TOTAL_WITH_AMOUNT, scoring.FILENAME_HINT, scoring.SENSITIVE, r"(?x) pay slip", r"\p{L}{7,}", "ſub", r"[a-z&&[^p]]ay", "a|total"]
    assert sum(bool(scoring.needed(p)) for p in patterns) == len(patterns) - 4
    for row in texts.select(F.array(*(scoring.meets(t, p, scoring.is_ascii(t), low).eqNullSafe(t.rlike(scoring.FLAGS + p)) for p in patterns)).alias("same")).collect():
        assert all(row.same)


def test_filters_of_candidates_do_not_look_for_the_patterns_again(spark):
    found = scoring.classify(spark.createDataFrame([("1", "a", "invoice", 1, 0, "ok")], EXTRACTED))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(labels.candidates(found, "scan/")).count("RLIKE(") == plan(found).count("RLIKE(") == plan(scoring.copy_targets(found)).count("RLIKE(")


def test_rules_as_a_table_give_the_same_scores(spark):
    rows = [("a", "Tax invoice, GSTIN, sub-total"), ("b", "nothing"), ("c", "pay slip"), ("d", None)]
    texts = spark.createDataFrame(rows, "k string, text string")
    got = dict(scoring.rule_hits(texts, scoring.rules_table(spark), "k").collect())
    assert got == {"a": 4 + 3 + 2 + 2, "b": 0, "c": -4, "d": 0}


def test_copies_keep_the_first_of_a_name(spark):
    rows = [("1", "b/x.pdf", "bill"), ("2", "a/x.pdf", "bill"), ("3", "a/x.pdf", "review"), ("4", "q.pdf", "not_bill")]
    got = {tuple(r) for r in scoring.copy_targets(spark.createDataFrame(rows, "sha256 string, file string, verdict string")).collect()}
    assert got == {("Bills", "x.pdf", "a/x.pdf", "2"), ("Bills_Review", "x.pdf", "a/x.pdf", "3")}


RECORD = "is_invoice boolean, customer string, vendor string, invoice_number string, invoice_date string, currency string, subtotal decimal(18,2), tax decimal(18,2), total decimal(18,2), gstin string, description string, category string"


def rec(subtotal=None, tax=None, total=None, gstin=None, **other):
    row = dict.fromkeys(FIELDS) | {"subtotal": subtotal, "tax": tax, "total": total, "gstin": gstin} | other
    return tuple(None if row[f] is None else D(row[f]) if f in ("subtotal", "tax", "total") else row[f] for f in FIELDS)


TEXT = "1,25,000.00 22,500.00 1,47,500.00 11,250.00"


@pytest.mark.parametrize(
    "given, wanted",
    [
        (rec("125000", "22500", "147500", "29ABCDE1234F1Z5"), ("125000.00", "22500.00", "147500.00", "29ABCDE1234F1Z5", "ok")),
        (rec("12500", "11250", "147500"), ("125000.00", "22500.00", "147500.00", None, "subtotal snapped to printed amount; tax derived as total - subtotal")),
        (rec("125000", "11250", "147500"), ("125000.00", "22500.00", "147500.00", None, "tax derived as total - subtotal")),
        (rec(), (None, None, None, None, "no total")),
        (rec(total="999"), (None, None, "999.00", None, "total not found in text")),
        (rec("150000", "5", "147500"), ("150000.00", "5.00", "147500.00", None, "subtotal+tax != total")),
        (rec("125000", "22500", "147500", "BAD"), ("125000.00", "22500.00", "147500.00", None, "invalid gstin dropped")),
        (rec("125000", "22500", "147500", ""), ("125000.00", "22500.00", "147500.00", "", "ok")),
    ],
)
def test_checks(spark, given, wanted):
    rows = spark.createDataFrame([(*given, TEXT)], RECORD + ", text string")
    row = checks.check(rows).first()
    assert tuple(None if x is None else str(x) for x in (row.subtotal, row.tax, row.total, row.gstin, row.check)) == wanted


def test_ledger_marks_guided_and_unreadable_rows(spark):
    rows = spark.createDataFrame(
        [("a", "ok", TEXT, True, *rec("125000", "22500", "147500")), ("b", "ok", TEXT, True, *rec()), ("c", "encrypted", "", False, *rec(total="5"))], "file string, status string, text string, guided boolean, " + RECORD
    )
    got = {r.file: r for r in checks.ledger(rows).collect()}
    assert got["a"].check == "fields filled one at a time"
    assert got["b"].check == "fields filled one at a time; no total"
    assert (got["c"].check, got["c"].total) == ("encrypted", None)
    assert checks.whole_amounts({"total": D("5.00"), "tax": D("1.50"), "vendor": "x"}) == {"total": 5, "tax": D("1.50"), "vendor": "x"}


def labelled(spark, **fields):
    base = dict(is_invoice=True, invoice_number="ACS/2026/0042", invoice_date="2026-09-15", subtotal="125000", tax="22500", total="147500") | fields
    return spark.createDataFrame([("s", "f.pdf", *rec(**base))], "sha256 string, file string, " + RECORD)


@pytest.mark.parametrize(
    "fields, wanted",
    [
        ({}, ""), ({"total": None}, "no total"), ({"total": "147501"}, "total not in text"), ({"invoice_number": "Z9"}, "invoice number not in text"), ({"tax": "5"}, "subtotal+tax != total"),
        ({"invoice_date": "2026-02-30"}, "bad date"), ({"is_invoice": False}, "teacher says not an invoice"), ({"is_invoice": None, "invoice_number": ""}, "teacher says not an invoice"),
    ],
)
def test_audit(spark, fields, wanted):
    texts = spark.createDataFrame([("s", TEXT + " acs 2026 0042")], "sha256 string, text string")
    row = labels.audit(labelled(spark, **fields), texts).first()
    assert (row.problems, row.approved) == (wanted, "" if wanted else "auto")


def test_corrections_override_to_null_and_ignore_notes(spark):
    fixes = spark.createDataFrame([("s", "total", None), ("s", "vendor", "New"), ("s", "_why", "x"), ("other", "vendor", "y")], "sha256 string, field string, value string")
    row = labels.corrected(labelled(spark, vendor="Old"), fixes).first()
    assert (row.total, row.vendor, row.subtotal) == (None, "New", D("125000.00"))


def test_candidates(spark):
    rows = [("1", "bill", False, "a/x"), ("2", "bill", True, "a/x"), ("3", "not_bill", False, "in/x"), ("4", "not_bill", False, "inn/x"), ("5", "encrypted", False, "in/x"), ("6", "review", False, "b")]
    df = spark.createDataFrame(rows, "sha256 string, verdict string, sensitive boolean, file string").withColumn("score", F.lit(1))
    assert sorted(r.sha256 for r in labels.candidates(df).collect()) == ["1", "6"]
    assert sorted(r.sha256 for r in labels.candidates(df, "in/").collect()) == ["1", "3", "6"]
    assert [r.file for r in labels.first_candidates(df, 2).collect()] == ["a/x", "a/x"]


def test_review_sheet_round_trip(spark):
    texts = spark.createDataFrame([("s", TEXT)], "sha256 string, text string")
    sheet = labels.review_sheet(labels.audit(labelled(spark, vendor=None), texts))
    row = labels.typed_review(sheet).first()
    assert (row.is_invoice, row.vendor, row.total, row.problems) == (True, None, D("147500.00"), "invoice number not in text")


def loop_split(sizes, test, valid):
    """The quota rule as a loop."""
    have, out = {"test": 0, "valid": 0}, []
    for n in sizes:
        name = "test" if have["test"] < test else "valid" if have["valid"] < valid else "train"
        if name != "train":
            have[name] += n
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_split_is_the_loop(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = [rng.randint(1, 6) for _ in range(60)]
    grouped = spark.createDataFrame([(f"g{i:03}", n, i) for i, n in enumerate(sizes)], "group_key string, n long, rank long")
    got = {r.group_key: r.split for r in dataset.quota_split(grouped).collect()}
    assert [got[f"g{i:03}"] for i in range(60)] == loop_split(sizes, 25, 15)


def test_pinned_groups_stay_in_the_test_set(spark):
    grouped = spark.createDataFrame([(f"g{i:02}", 4, i) for i in range(20)], "group_key string, n long, rank long")
    pinned = spark.createDataFrame([("g05",), ("g09",), ("g09",)], "group_key string")
    got = {r.group_key: r.split for r in dataset.quota_split(grouped, pinned=pinned).collect()}
    assert sorted(k for k, v in got.items() if v == "test") == ["g05", "g09"]
    assert sorted(k for k, v in got.items() if v == "valid") == ["g00", "g01", "g02", "g03"]


def test_vendors_are_capped_in_training_only(spark):
    rows = [(f"s{i:02}", "Acme" if i % 2 else "ACME", "train", i, f"g{i}") for i in range(20)] + [("t", "acme", "test", 99, "g99"), ("n", None, "train", 98, "g98")]
    df = spark.createDataFrame(rows, "sha256 string, vendor string, split string, rank long, group_key string")
    got = [r.sha256 for r in dataset.cap_vendors(df).collect()]
    assert len(got) == 18 and {"t", "n", "s15"} <= set(got) and "s16" not in got


def test_copies_share_a_group(spark):
    rows = [("1", "A", "7", D(5)), ("2", "a", "7", D(5)), ("3", "a", None, D(5)), ("4", "a", "", D(5)), ("5", None, "7", None)]
    df = spark.createDataFrame(rows, "sha256 string, vendor string, invoice_number string, total decimal(18,2)")
    keys = {r.sha256: r.k for r in df.select("sha256", dataset.group_key().alias("k")).collect()}
    assert keys["1"] == keys["2"] and len(set(keys.values())) == 4 and keys["5"] == '["none","7","none"]'


@pytest.mark.parametrize(
    "field, answer, want, right",
    [
        ("total", '{"total": null}', None, True), ("total", '{"total": "125,000"}', D(125000), True), ("total", '{"total": 125000.01}', D(125000), True), ("total", '{"total": "x"}', D(5), False),
        ("total", '{"total": "x"}', None, False), ("total", "{}", D(5), False), ("vendor", '{"vendor": "Amazon Web Services"}', "AWS India", False), ("vendor", '{"vendor": "Airtel"}', "Airtel Ltd", True),
        ("vendor", '{"vendor": null}', "Airtel", False), ("currency", '{"currency": "INR"}', "inr", True), ("is_invoice", '{"is_invoice": true}', "true", True), ("gstin", "{}", None, True),
    ],
)
def test_field_correct(spark, field, answer, want, right):
    kind = "decimal(18,2)" if field == "total" else "string"
    from paperledger.functions.record import parse_object

    df = spark.createDataFrame([(answer, want)], f"a string, w {kind}")
    assert df.select(evaluation.field_correct(field, parse_object(F.col("a")), F.col("w"))).first()[0] is right


def test_evaluation(spark):
    whole = '{"is_invoice": true, "customer": "c", "vendor": "v", "invoice_number": "1", "invoice_date": "d", "currency": "INR", "subtotal": 1, "tax": 1, "total": 2, "gstin": null, "category": "Rent"}'
    wanted = spark.createDataFrame([(k, True, "c", "v", "1", "d", "INR", D(1), D(1), D(2), None, "x", "Rent") for k in "ab"], "doc_id string, " + RECORD)
    answers = spark.createDataFrame([("a", "m", whole, 2.0), ("b", "m", "nonsense" * 20, 4.0)], "doc_id string, model string, output string, seconds double")
    judged = evaluation.judge(answers, wanted)
    assert {(r.n, r.n_correct) for r in evaluation.field_accuracy(judged).collect()} == {(2, 1)}
    assert tuple(evaluation.document_scores(judged).first()) == ("m", 2, 1, 1, 3.0)
    assert [(r.field, len(r.detail)) for r in evaluation.misses(judged).collect()] == [("invalid json", 80)]
    assert {r.m for r in evaluation.head_to_head(evaluation.field_accuracy(judged), ["m"]).collect()} == {500}


def test_paths_are_ordered_by_their_parts(spark):
    df = spark.createDataFrame([(b"x", "a-b/c"), (b"x", "a/b"), (b"y", "z")], "content binary, path string")
    assert {r.path for r in reports.content_dedup(df, "content", "path").collect()} == {"a/b", "z"}
    assert tuple(reports.content_counts(df, "content").first()) == (3, 2)


def test_reports(spark):
    rows = [("f2", True, "A", "1", D(5), "c"), ("f1", True, "a", "1", D(5), "c"), ("f3", True, "B", None, D(7), "Your Name"), ("f4", False, "B", "2", D(9), None), ("f5", True, "B", "3", None, None)]
    df = spark.createDataFrame(rows, "file string, is_invoice boolean, vendor string, invoice_number string, total decimal(18,2), customer string").withColumn("currency", F.lit("INR"))
    assert sorted(r.file for r in reports.dedup_bills(df).collect()) == ["f1", "f3", "f4", "f5"]
    assert [(r.vendor, r.spend) for r in reports.spend_by_vendor(df).collect()] == [("B", D("7.00")), ("A", D("5.00")), ("a", D("5.00"))]
    assert [r.file for r in reports.addressed_to(df, "your name").collect()] == ["f3"]


def test_repeated_corrections_have_a_winner(spark):
    fixes = [("s", "vendor", "B", 1), ("s", "vendor", "A", 2), ("s", "total", "7", 3), ("s", "total", None, 4)]
    df = spark.createDataFrame(fixes, "sha256 string, field string, value string, nth int")
    row = labels.corrected(labelled(spark, vendor="Old"), df).first()
    assert (row.vendor, row.total) == ("A", None)
    row = labels.corrected(labelled(spark, vendor="Old"), df.drop("nth")).first()
    assert (row.vendor, row.total) == ("B", D("7.00"))


def test_keys_that_look_alike_when_joined_differ(spark):
    rows = [("1", "a|b", "c", D(5)), ("2", "a", "b|c", D(5)), ("3", 'a","b', "c", D(5)), ("4", "a", 'b","c', D(5))]
    df = spark.createDataFrame(rows, "sha256 string, vendor string, invoice_number string, total decimal(18,2)")
    assert dataset.groups(df).count() == 4


def test_split_rows_is_assign(spark):
    rows = [(str(i), f"v{i % 7}", str(i % 90), D(1)) for i in range(200)]
    df = spark.createDataFrame(rows, "sha256 string, vendor string, invoice_number string, total decimal(18,2)")
    wanted = dataset.assign(df, dataset.quota_split(dataset.groups(df)))
    assert sorted(map(tuple, dataset.split_rows(df).select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_report_in_percents(spark):
    judged = spark.createDataFrame([(str(i), "m", 1.0, True, f, i < k) for f, k in (("total", 5), ("tax", 8)) for i in range(8)], "doc_id string, model string, seconds double, valid boolean, field string, correct boolean")
    assert dict(evaluation.report(judged, ["m"]).collect()) == {"total": "62%", "tax": "100%", "valid JSON": "100%", "ALL fields right": "62%"}


def test_totals_are_those_of_judged_fields(spark):
    answers = [('{"vendor": "Acme Ltd", "total": "Rs 5.00", "tax": true}', "m"), ('{"vendor": "acme", "total": 6, "is_invoice": true}', "m"), ("{", "m"), ('{"vendor": null, "currency": "Inr"}', "k")]
    rows = [(str(i), m, o, float(i), *rec(total="5", vendor="ACME", currency="INR", is_invoice=True)) for i, (o, m) in enumerate(answers)]
    both = spark.createDataFrame(rows, "doc_id string, model string, output string, seconds double, " + RECORD)
    judged, total = evaluation.judge_joined(both), evaluation.totals(both)
    of = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert of(evaluation.accuracy_of(total)) == of(evaluation.field_accuracy(judged))
    assert of(total.drop("right")) == of(evaluation.document_scores(judged))
    assert of(evaluation.misses_of(total)) == of(evaluation.misses(judged).groupBy("model", "field").count())
    assert of(evaluation.report_of(total, ["m", "k"])) == of(evaluation.report(judged, ["m", "k"]))


def test_texts_of_fields_at_once_are_those_of_each_field(spark):
    values = ['"x"', "5", "5.10", "1e3", "true", "null", "{}", '{"total": 7}', "[1, null]", '""', '"a\\nb"']
    outputs = ["{}", "[]", "7", *(f'{{"total": {v}, "other": {v}, "vendor": "V"}}' for v in values)]
    rows = spark.createDataFrame([(x,) for x in outputs], "o string").withColumn("v", F.try_parse_json("o"))
    names = ["vendor", "total", "tax"]
    for row in rows.select(record.text_fields(F.col("v")).alias("x"), *(record.text_field(F.col("v"), f).alias(f) for f in names)).collect():
        assert tuple((row.x or {}).get(f) for f in names) == tuple(row[f] for f in names)


def test_records_and_answers_are_read_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    answers = spark.createDataFrame([("a", "ok", TEXT, "{}")], "file string, status string, text string, output string")
    spend = plan(reports.spend_by_vendor(checks.ledger(checks.typed(answers))))
    assert (spend.count("regexp_extract_all("), spend.count("parseJson(")) == (1, 1)
    both = spark.createDataFrame([("1", "m", "{}", 1.0, *rec())], "doc_id string, model string, output string, seconds double, " + RECORD)
    for df in (evaluation.report_of(evaluation.totals(both), ["m"]), evaluation.misses(evaluation.judge_joined(both))):
        assert plan(df).count("parseJson(") == 1
