"""Unit tables of the expressions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperledger.functions import record, text
from paperledger.schema import FIELDS


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("1,25,000.00 and 1,234,567.89 x", "125000.00 and 1234567.89 x"), ("80,000.00", "80000.00"), ("1,2,3", "1,2,3"), ("12,34", "12,34"), ("9,999,99", "9,999,99"),
        ("12,345,", "12,345,"), (",1,000", ",1,000"), ("1,00,000", "100000"), ("12,34,567.89 1,000,000", "1234567.89 1000000"), ("2,026-09", "2026-09"), ("1,234.5.6", "1234.5.6"),
        ("a1,000b", "a1000b"), ("", ""), ("no numbers", "no numbers"), (None, None),
    ],
)
def test_normalize_numbers(spark, given, wanted):
    assert one(spark, text.normalize_numbers, given) == wanted
    if wanted:
        assert one(spark, text.normalize_numbers, wanted) == wanted


def test_truncate(spark):
    assert one(spark, text.truncate, "a" * 6000) == "a" * 6000
    assert one(spark, text.truncate, "a" * 4000 + "b" * 2001) == "a" * 4000 + "\n[...]\n" + "b" * 2000


def test_prepare_normalises_before_it_truncates(spark):
    assert len(one(spark, text.prepare, "1,000 " * 1200)) == 6000


def test_numbers_in(spark):
    found = one(spark, text.numbers_in, "1,25,000.00 CGST 9% 12, 2026-09-15 1.2.3")
    assert set(found) == {Decimal(x) for x in ("125000", "9", "12", "2026", "15", "1.2", "3")}
    assert one(spark, text.numbers_in, "9" * 40) == []


@pytest.mark.parametrize("given, wanted", [("29ABCDE1234F1Z5", True), ("9926USA29037OS3", True), (" 29ABCDE1234F1Z5\n", True), ("29abcde1234f1z5", False), ("29ABCDE1234F1Z55", False), ("000000", False)])
def test_gstin(spark, given, wanted):
    assert one(spark, text.valid_gstin, given) is wanted


@pytest.mark.parametrize("given, wanted", [("2026-09-15", True), ("2026-02-30", False), ("2026-9-5", False), ("2026", False), ("2026-09-15T", False)])
def test_date(spark, given, wanted):
    assert one(spark, text.valid_date, given) is wanted


@pytest.mark.parametrize("a, b, wanted", [("12500", "125000", True), ("147500", "14750", True), ("125000", "125000", False), ("125000", "135000", False), ("12.5", "125", True)])
def test_one_digit_apart(spark, a, b, wanted):
    assert spark.range(1).select(text.one_digit_apart(F.lit(a), F.lit(b))).first()[0] is wanted


def test_digits(spark):
    assert [one(spark, text.digits, Decimal(x), "decimal(18,2)") for x in ("125000.00", "12.50", "0.05")] == ["125000", "12.5", "0.05"]


def test_squash_and_norm(spark):
    assert one(spark, text.squash, "ACS/2026 00-42_x y") == "acs20260042xy"
    assert one(spark, text.norm, "Aïr-Tel Ltd. 9") == "artelltd9"


@pytest.mark.parametrize("given, valid", [('Here: {"a":1} done', True), ('{"a":1} y {"b":2}', False), ('{"a":1,}', False), ("{'a':1}", False), ("no braces", False), ("", False), (None, False), ('{"a":{"b":[1]}}', True)])
def test_parse_object(spark, given, valid):
    assert one(spark, lambda c: record.parse_object(c).isNotNull(), given) is valid


@pytest.mark.parametrize("given, wanted", [("₹ 1,234.50", "1234.50"), ("1.", "1.00"), (".5", "0.50"), ("", None), ("-", None), ("--5", None), ("1.2.3", None), ("n/a", None)])
def test_as_number(spark, given, wanted):
    assert one(spark, record.as_number, given) == (wanted and Decimal(wanted))


@pytest.mark.parametrize("given, wanted", [('"a, b", "x"', '"a, b"'), ('12.5, "tax"', "12.5"), ("null}", "null"), ('"esc \\" , q"}', '"esc \\" , q"'), ('"unterminated, ', ""), ("[1, 2]", "[1"), ("true", "")])
def test_value_end(spark, given, wanted):
    from paperledger.sources.model import value_of

    assert one(spark, record.value_end, given) == wanted
    assert (value_of(given) or "") == wanted


def cleaned(spark, output):
    return spark.createDataFrame([(output,)], "x string").select(*record.clean(record.parse_object(F.col("x")))).first()


def test_clean(spark):
    row = cleaned(spark, '{"is_invoice": "yes", "subtotal": "Rs 1,200.50", "tax": true, "total": 3, "category": "Groceries", "vendor": "A"}')
    assert (row.is_invoice, row.subtotal, row.tax, row.total, row.category, row.vendor, row.gstin) == (None, Decimal("1200.50"), None, Decimal("3.00"), None, "A", None)
    row = cleaned(spark, '{"is_invoice": false, "category": "Travel", "total": null, "subtotal": 1.5}')
    assert (row.is_invoice, row.category, row.total, row.subtotal) == (False, "Travel", None, Decimal("1.50"))


def test_complete_looks_at_keys_only(spark):
    whole = "{" + ", ".join(f'"{f}": null' for f in FIELDS) + "}"
    assert one(spark, record.complete, whole) is True
    assert one(spark, record.complete, '{"total": 1}') is False
    assert one(spark, record.complete, "nothing") is False


def test_to_json_keeps_order_nulls_and_letters(spark):
    import json

    names = {"is_invoice": "boolean", "subtotal": "decimal(18,2)", "tax": "decimal(18,2)", "total": "decimal(18,2)"}
    row = (True, 'Ünï "q"', None, "1", None, "INR", Decimal("10.00"), Decimal("1.50"), None, None, "a\nb", "Rent")
    out = spark.createDataFrame([row], ", ".join(f"{f} {names.get(f, 'string')}" for f in FIELDS)).select(record.to_json()).first()[0]
    assert list(json.loads(out)) == FIELDS
    assert json.loads(out) == dict(zip(FIELDS, (True, 'Ünï "q"', None, "1", None, "INR", 10, 1.5, None, None, "a\nb", "Rent"), strict=True))
    assert "Ünï" in out and ":10," in out


def test_digits_of_other_scripts(spark):
    assert one(spark, text.numbers_in, "₹ १,२३४.५० und ٧٫ ٨٩ 𝟙𝟚") == [Decimal("1234.50"), Decimal(7), Decimal(89), Decimal(12)]
    assert one(spark, record.as_number, "₹ १,२३४.५०") == Decimal("1234.50")
    assert one(spark, text.normalize_numbers, "१,२३,४५६.०० 1,000") == "१२३४५६.०० 1000"
