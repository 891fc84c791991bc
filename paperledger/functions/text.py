"""Text expressions, all native columns."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperledger.schema import HEAD_CHARS, MAX_CHARS

# ---- Fixed values: patterns, in which digits are those of any script. ----
GROUPED_NUMBER = r"(?U)(?<![\d,.])(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})+,\d{3})(?=\.\d|(?![\d,]))"
NUMBER = r"(?U)\d[\d,]*(?:\.\d+)?"
GSTIN = r"\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]|\d{4}[A-Z]{3}\d{5}[A-Z]{2}[A-Z\d]"
CUT = "\n[...]\n"
DOCUMENT = "DOCUMENT:\n"

#: The decimal digits of other scripts, in runs from zero to nine.
OTHER_DIGITS = "".join(chr(c) for c in range(0x80, sys.maxunicode) if unicodedata.category(chr(c)) == "Nd")


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    plain = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)
    other = (F.octet_length(text) != F.length(text)) & text.rlike(r"(?U)[\d&&[^0-9]]")
    return F.when(other, F.translate(text, OTHER_DIGITS, plain)).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_numbers(text: Column) -> Column:
    """Drops the commas of grouped amounts, western or lakh, and leaves all other text alone."""
    between = F.split(text, GROUPED_NUMBER, -1)
    amounts = F.transform(F.regexp_extract_all(text, F.lit(GROUPED_NUMBER), F.lit(0)), lambda m: F.replace(m, F.lit(","), F.lit("")))
    return F.array_join(F.zip_with(between, F.concat(amounts, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def truncate(text: Column) -> Column:
    """Keeps the head and the tail of a long text."""
    tail = MAX_CHARS - HEAD_CHARS
    return F.when(F.length(text) > MAX_CHARS, F.concat(F.left(text, F.lit(HEAD_CHARS)), F.lit(CUT), F.right(text, F.lit(tail)))).otherwise(text)


def prepare(text: Column) -> Column:
    """What a model gets to see: amounts normalised first, then truncated."""
    return truncate(normalize_numbers(text))


def user_message(text: Column) -> Column:
    return F.concat(F.lit(DOCUMENT), text)


def numbers_in(text: Column) -> Column:
    """The distinct amounts that a text prints, as decimals of two places."""
    found = F.transform(F.regexp_extract_all(ascii_digits(text), F.lit(NUMBER.removeprefix("(?U)")), F.lit(0)), lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("decimal(18,2)"))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def squash(text: Column) -> Column:
    """Lower case, without white space, hyphens, underscores and slashes."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\-_/]", ""))


def norm(value: Column) -> Column:
    """Lower-case letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]", "")


def valid_gstin(value: Column) -> Column:
    return stripped(value).rlike(rf"\A(?:{GSTIN})\z")


def valid_date(value: Column) -> Column:
    """Whether a text is a calendar date written YYYY-MM-DD."""
    return value.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def digits(amount: Column) -> Column:
    """An amount of two places without zeros or a point at its end."""
    return F.rtrim(F.rtrim(amount.cast("decimal(18,2)").cast("string"), F.lit("0")), F.lit("."))


def one_digit_apart(a: Column, b: Column) -> Column:
    """Whether one text is the other with one character more."""
    return (F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) == 1)
