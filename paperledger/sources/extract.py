"""Text out of files, at one boundary to Python.

An extractor maps the bytes of one file to (text, page_count, ocr_pages, status, error). The default one reads
UTF-8 text; the one for PDF files and photos uses its libraries where they are installed. ``error`` is null unless
a file can't be read.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.schema import EXTRACTION, MAX_PAGES, MIN_TEXT_CHARS, OCR_DPI, SHORT_OCR_CHARS
from paperledger.session import ship
from paperledger.tables import Scratch

Extraction = tuple[str, int, int, str, str | None]
#: Bytes of paths that are broadcast at most.
SENT_BYTES = 64 << 20


def unreadable(error: Exception) -> Extraction:
    return "", 0, 0, "unreadable", f"{type(error).__name__}: {error}"


def plain_text(content: bytes, path: str) -> Extraction:
    """Pages are divided by form feeds; no more than the first few are kept."""
    try:
        pages = content.decode("utf-8").split("\f")
    except UnicodeDecodeError as error:
        return unreadable(error)
    return "\n".join(f"--- page {i} ---\n{p}" for i, p in enumerate(pages[:MAX_PAGES], 1)), len(pages), 0, "ok", None


def longer(first: str, second: str) -> str:
    """The strictly longer text, the first one on a tie, by what is left without white space at the ends."""
    return second if len(second.strip()) > len(first.strip()) else first


def recognise_page(page) -> str:
    import pytesseract

    image = page.render(scale=OCR_DPI / 72).to_pil()
    read = pytesseract.image_to_string(image)
    if len(read.strip()) < SHORT_OCR_CHARS:
        read = longer(read, pytesseract.image_to_string(image, config="--psm 6"))
    return read


def open_image(content: bytes):
    """An image of any known kind; those of phones, too, where their library is installed."""
    from PIL import Image

    with contextlib.suppress(ImportError):
        import pillow_heif

        pillow_heif.register_heif_opener()
    return Image.open(io.BytesIO(content))


def photo(content: bytes) -> Extraction:
    import pytesseract
    from PIL import ImageOps

    image = ImageOps.exif_transpose(open_image(content)).convert("L")
    if image.width < 1500:
        image = image.resize((1500, round(image.height * 1500 / image.width)))
    return "--- page 1 ---\n" + pytesseract.image_to_string(ImageOps.autocontrast(image), config="--psm 4"), 1, 1, "ok", None


def pdf(content: bytes) -> Extraction:
    """The text layer of the first pages; a page with hardly any goes through optical recognition."""
    import pypdfium2 as pdfium

    try:
        pages = pdfium.PdfDocument(content)
    except pdfium.PdfiumError as error:
        return ("", 0, 0, "encrypted", None) if "password" in str(error).lower() else unreadable(error)
    parts, recognised = [], 0
    for i in range(min(len(pages), MAX_PAGES)):
        read = pages[i].get_textpage().get_text_range()
        if len(read.strip()) < MIN_TEXT_CHARS:
            try:
                read = recognise_page(pages[i])
                recognised += 1
            except Exception:  # a page that can't be recognised stays empty
                read = ""
        parts.append(f"--- page {i + 1} ---\n{read}")
    return "\n".join(parts), len(pages), recognised, "ok", None


def document(content: bytes, path: str) -> Extraction:
    """PDF files by their text layer, pages without one and photos by optical recognition."""
    try:
        return pdf(content) if path.lower().endswith(".pdf") else photo(content)
    except ImportError:
        raise
    except Exception as error:
        return unreadable(error)


def extract(files: DataFrame, extractor: Callable[[bytes, str], Extraction] = plain_text, partitions: int | None = None) -> DataFrame:
    """(sha256, file, text, page_count, ocr_pages, status, error) of (sha256, path, content), a file at a time.

    Contents are read where they are extracted; with ``partitions`` rows are dealt evenly beforehand, which
    pays if a file takes long.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame([(row.sha256, row.path, *extractor(bytes(row.content), row.path))], columns=EXTRACTION.fieldNames())

    rows = files.select("sha256", "path", "content")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, EXTRACTION)


def with_content(unique: DataFrame, files: DataFrame) -> DataFrame:
    """(sha256, path, content) of the first file of each content.

    The paths of the other files are stored and, if they are few by their measured size, sent to all executors: then
    no content is moved. Else rows meet by path, which moves contents once; all files are read either way.
    """
    scratch = Scratch(files.sparkSession)
    others = scratch(files.select("path").join(unique.select("path"), "path", "left_anti"))
    size = others.agg(F.sum(F.octet_length("path") + 16)).first()[0] or 0
    kept = files.select("path", "content").join(F.broadcast(others) if size <= SENT_BYTES else others.hint("merge"), "path", "left_anti")
    return kept.select(F.sha2("content", 256).alias("sha256"), "path", "content")


def chosen_content(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """(sha256, path, content) of some of the files, given by (sha256, path): as ``with_content``, but the chosen paths are sent."""
    few = Scratch(files.sparkSession)(chosen.select("sha256", "path"))
    size = few.agg(F.sum(F.octet_length("path") + 80)).first()[0] or 0
    joined = files.select("path", "content").join(F.broadcast(few) if size <= SENT_BYTES else few.hint("merge"), "path")
    return joined.select("sha256", "path", "content")


def failed_reads(extracted: DataFrame) -> DataFrame:
    """(status, error, n) of what couldn't be read."""
    return extracted.where(F.col("status") != "ok").groupBy("status", "error").agg(F.count("*").alias("n"))
