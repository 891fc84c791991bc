"""Record types, fields and fixed tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DecimalType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

MONEY = DecimalType(18, 2)


def struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


_S, _I, _B = StringType(), IntegerType(), BooleanType()

# ---- Fixed values: field names and their order, categories, limits. ----
FIELDS = ["is_invoice", "customer", "vendor", "invoice_number", "invoice_date", "currency", "subtotal", "tax", "total", "gstin", "description", "category"]
AMOUNTS = ["subtotal", "tax", "total"]
TEXTS = ["customer", "vendor", "invoice_number", "invoice_date", "currency", "gstin", "description", "category"]
SCORED = [f for f in FIELDS if f != "description"]
CATEGORIES = [
    "Cloud & Hosting", "Software & SaaS", "Telecom & Internet", "Utilities", "Travel", "Food & Dining", "Shopping",
    "Professional Services", "Government & Taxes", "Finance & Banking", "Rent", "Healthcare", "Education", "Other",
]
SUFFIXES = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".tif", ".tiff", ".avif", ".pdf"]
MAX_CHARS, HEAD_CHARS = 6000, 4000
MAX_PAGES, MIN_TEXT_CHARS, OCR_DPI, SHORT_OCR_CHARS = 4, 50, 300, 600
BILL_THRESHOLD, REVIEW_THRESHOLD = 8, 4
TEST_DOCS, VALID_DOCS, MAX_PER_VENDOR, SPLIT_SEED = 25, 15, 16, 42

RECORD = struct(is_invoice=_B, customer=_S, vendor=_S, invoice_number=_S, invoice_date=_S, currency=_S, subtotal=MONEY, tax=MONEY, total=MONEY, gstin=_S, description=_S, category=_S)
#: The answer schema that a teacher must keep to.
ANSWER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": FIELDS,
    "properties": {f: {"type": "boolean"} if f == "is_invoice" else {"type": ["number" if f in AMOUNTS else "string", "null"]} | ({"enum": [*CATEGORIES, None]} if f == "category" else {}) for f in FIELDS},
}
FILE = struct(path=_S, modificationTime=TimestampType(), length=LongType(), content=BinaryType())
EXTRACTION = struct(sha256=_S, file=_S, text=_S, page_count=_I, ocr_pages=_I, status=_S, error=_S)
TEXT_CACHE = struct(sha256=_S, text=_S)
CLASSIFICATION = struct(sha256=_S, file=_S, verdict=_S, score=_I, pages=_I, ocr_pages=_I, sensitive=_B, reasons=_S)
LABEL = StructType([*RECORD.fields, StructField("_source_file", _S), StructField("_teacher", _S)])
RESULT = StructType([StructField("file", _S), *RECORD.fields, StructField("check", _S)])
REVIEW = struct(**{f: _S for f in ["problems", "approved", "file", *FIELDS, "sha256"]})
CORRECTIONS = MapType(_S, MapType(_S, _S))
CHAT = struct(messages=ArrayType(struct(role=_S, content=_S)))
TEST_FILES = struct(file=_S, sha256=_S)
PREDICTION = struct(doc_id=_S, output=_S, seconds=DoubleType())
