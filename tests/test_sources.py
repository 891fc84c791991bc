"""Files in, tables and files out, incremental runs and the golden documents."""

import json
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperledger.operators import dataset, labels
from paperledger.plans import stages
from paperledger.schema import FIELDS
from paperledger.sources import extract, files, model, sinks

GST = "\n".join([
    "TAX INVOICE", "Acme Cloud Services Pvt Ltd", "GSTIN: 29ABCDE1234F1Z5", "Invoice No: ACS/2026/0042", "Invoice Date: 15-09-2026", "Bill To: Demo Customer LLP",
    "Compute 80,000.00", "Storage 30,000.00", "HSN 998313 15,000.00", "Subtotal 1,25,000.00", "CGST 9% 11,250.00", "SGST 9% 11,250.00", "Grand Total ₹ 1,47,500.00",
])


def forgetful():
    """A model that drops a zero and knows only one half of the tax; its first answer to a receipt isn't JSON."""

    class Forgetful(model.RuleBackend):
        def answer(self, document):
            out = model.RuleBackend.answer(self, document)
            if out["subtotal"] == 125000:
                out |= {"subtotal": 12500, "tax": 11250}
            return out

        def stream(self, prompt, max_tokens):
            if "RECEIPT" in prompt and prompt.endswith("ANSWER: "):
                yield "I can't say"
            else:
                yield from model.RuleBackend.stream(self, prompt, max_tokens)

    return Forgetful


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sample_gst_invoice.PDF").write_text(GST)
    (tmp_path / "in/sub/copy.pdf").write_text(GST)
    (tmp_path / "in/sub/cafe.jpg").write_text("RECEIPT\nCafé\nBill No: 7\nSubtotal 500.00\nTax 25.00\nGrand Total 525.00")
    (tmp_path / "in/bad.pdf").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "in/notes.txt").write_text("not scanned")
    return tmp_path


def test_from_files_to_ledger(spark, folder):
    texts = stages.extracted(spark, str(folder / "in")).cache()
    assert sorted(r.file for r in texts.collect()) == ["bad.pdf", "sample_gst_invoice.PDF", "sub/cafe.jpg"]
    verdicts = {r.file: (r.verdict, r.score) for r in stages.classified(texts).collect()}
    assert verdicts["sample_gst_invoice.PDF"] == ("bill", 28) and verdicts["bad.pdf"] == ("unreadable", 0)
    got = {r.file: r for r in stages.to_ledger(texts, forgetful()).collect()}
    bill = got["sample_gst_invoice.PDF"]
    assert (bill.subtotal, bill.tax, bill.total, bill.check) == (Decimal(125000), Decimal(22500), Decimal(147500), "subtotal snapped to printed amount; tax derived as total - subtotal")
    assert (bill.is_invoice, bill.customer, bill.invoice_number, bill.gstin) == (True, "Demo Customer LLP", "ACS/2026/0042", "29ABCDE1234F1Z5")
    assert (got["sub/cafe.jpg"].total, got["sub/cafe.jpg"].check) == (Decimal(525), "fields filled one at a time")
    assert (got["bad.pdf"].check, got["bad.pdf"].total) == ("unreadable", None)
    texts.unpersist()


def test_inputs(spark, folder):
    found = files.inputs(spark, [str(folder / "in"), str(folder / "in/sub/cafe.jpg"), str(folder / "missing")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == ["bad.pdf", "cafe.jpg", "sample_gst_invoice.PDF"]
    with pytest.raises(ValueError):
        files.inputs(spark, [str(folder / "missing")])


def test_pages_and_failures_of_the_text_extractor():
    assert extract.plain_text(b"a\fb\fc\fd\fe", "x") == ("--- page 1 ---\na\n--- page 2 ---\nb\n--- page 3 ---\nc\n--- page 4 ---\nd", 5, 0, "ok", None)
    assert extract.plain_text(b"\xff", "x")[3] == "unreadable" and extract.plain_text(b"\xff", "x")[4].startswith("UnicodeDecodeError")
    assert extract.longer("ab", " c ") == "ab" and extract.longer("a", "bc") == "bc"


def test_guided_answers_and_events():
    assert json.loads(model.fill_fields(forgetful()(), "DOCUMENT:\nRECEIPT\nCafe\nGrand Total 5.00\n\nANSWER: "))["total"] == 5.0
    lines = [b"", b'data: {"content": "a"}', b": note", b'data: {"content": "b", "stop": true}', b'data: {"content": "c"}']
    assert "".join(model.events(lines)) == "ab"


def test_a_failing_document_does_not_end_the_run(spark):
    class Broken(model.RuleBackend):
        def stream(self, prompt, max_tokens):
            raise RuntimeError("no")

    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "sha256 string, prepared string")
    assert {(r.status, r.error) for r in model.teach(rows, Broken).collect()} == {("FAILED", "no")}
    assert {r.status for r in model.teach(rows).collect()} == {"labelled"}


def label_row(spark, n=3):
    schema = "sha256 string, file string, teacher string, " + ", ".join(f"{f} {'boolean' if f == 'is_invoice' else 'decimal(18,2)' if f in ('subtotal', 'tax', 'total') else 'string'}" for f in FIELDS)
    rows = [(f"s{i}", f"f{i}", "t", True, 'c, "q"\nline', "Vé", f"{i}", None, "INR", Decimal(1), Decimal(1), Decimal(2), None, "", "Rent") for i in range(n)]
    return spark.createDataFrame(rows, schema)


def test_labels_corrections_and_sheets_round_trip(spark, tmp_path):
    rows = label_row(spark)
    (tmp_path / "labels").mkdir()
    for r in sinks.label_lines(rows).collect():
        record = json.loads(r.value) | {"_source_file": f"{r.sha256}.pdf", "_teacher": "t"}
        (tmp_path / f"labels/{r.sha256}.json").write_text(json.dumps(record, indent=1, ensure_ascii=False))
    (tmp_path / "fix.json").write_text(json.dumps({"s1": {"total": None, "_note": "x"}, "s2": {"vendor": "W"}}))
    read = files.label_files(spark, str(tmp_path / "labels"))
    fixed = {r.sha256: r for r in labels.corrected(read, files.corrections(spark, str(tmp_path / "fix.json"))).collect()}
    assert (fixed["s0"].vendor, fixed["s1"].total, fixed["s2"].vendor, fixed["s0"].customer) == ("Vé", None, "W", 'c, "q"\nline')
    assert files.corrections(spark, str(tmp_path / "none.json")).count() == 0
    texts = spark.createDataFrame([(f"s{i}", f"{i} 2.00") for i in range(3)], "sha256 string, text string")
    sinks.write_csv(labels.review_sheet(labels.audit(read, texts)), str(tmp_path / "review"), single=True)
    sheet = files.review(spark, str(tmp_path / "review"))
    typed = {r.sha256: r for r in labels.typed_review(sheet).collect()}
    assert len(typed) == 3 and typed["s0"].customer == 'c, "q"\nline' and typed["s0"].total == Decimal(2) and typed["s0"].gstin is None and typed["s0"].is_invoice is True


def test_splits_are_written_and_pinned(spark, tmp_path):
    rows = label_row(spark, 50).drop("teacher")
    split = dataset.quota_split(dataset.groups(rows))
    assigned = dataset.cap_vendors(dataset.assign(rows, split)).cache()
    texts = rows.select("sha256", F.concat(F.lit("text of "), "sha256").alias("text"))
    sinks.write_splits(dataset.chat(assigned, texts), str(tmp_path / "data"))
    sinks.write_test_files(assigned, str(tmp_path / "test_files"))
    pinned = files.pinned(spark, str(tmp_path / "test_files"))
    assert pinned.count() == 25 and files.pinned(spark, str(tmp_path / "no")).count() == 0
    chats = files.chat_examples(spark, str(tmp_path / "data"))
    roles = chats.select(F.transform("messages", lambda m: m["role"]).alias("r")).distinct().collect()
    assert [r.r for r in roles] == [["system", "user", "assistant"]]
    assert chats.select(F.get_json_object(dataset.expected(F.col("messages")), "$.vendor").alias("v")).distinct().first().v == "Vé"
    keys = rows.join(pinned.select("sha256"), "sha256").select(dataset.group_key().alias("group_key"))
    again = dataset.quota_split(dataset.groups(rows), pinned=keys)
    assert again.where("split = 'test'").join(keys, "group_key", "left_anti").count() == 0
    assigned.unpersist()


def test_copies_are_made_once(spark, folder):
    targets = spark.createDataFrame([("Bills", "a.pdf", str(folder / "in/sub/copy.pdf"))], "target string, name string, path string")
    assert sinks.copy_files(targets, str(folder)).first().copied is True
    assert sinks.copy_files(targets, str(folder)).first().copied is False
    assert (folder / "Bills/a.pdf").read_text() == GST


def test_incremental_ingestion(spark, folder):
    from paperledger.streaming.ingest import ingest

    cache, state = str(folder / "cache"), str(folder / "state")
    ingest(spark, str(folder / "in"), cache, state).awaitTermination()
    first = {r.sha256 for r in spark.read.parquet(cache).collect()}
    shutil.copy(folder / "in/sub/cafe.jpg", folder / "in/sub/again.jpg")
    (folder / "in/new.pdf").write_text("new")
    ingest(spark, str(folder / "in"), cache, state).awaitTermination()
    rows = spark.read.parquet(cache)
    assert rows.count() == rows.select("sha256").distinct().count() == len(first) + 1


def test_each_document_goes_to_the_model_once(spark, tmp_path):
    """Whole answers and rounds field by field leave a line each."""
    log = str(tmp_path / "asked")

    class Counting(forgetful()):
        def stream(self, prompt, max_tokens):
            if prompt.endswith("ANSWER: ") or prompt.endswith('{"is_invoice": '):
                with open(log, "a") as out:
                    out.write(("whole" if prompt.endswith("ANSWER: ") else "guided") + "\n")
            yield from super().stream(prompt, max_tokens)

    rows = [(f"{i}.pdf", "ok", ("RECEIPT" if i % 4 == 0 else "INVOICE") + f"\nShop\nGrand Total {i + 1}.00") for i in range(20)] + [("x.pdf", "encrypted", ""), ("y.pdf", None, None)]
    texts = spark.createDataFrame(rows, "file string, status string, text string")
    got = {r.file: r for r in stages.to_ledger(texts, Counting).collect()}
    asked = (tmp_path / "asked").read_text().split()
    assert (asked.count("whole"), asked.count("guided"), len(got)) == (20, 5, 22)
    assert (got["4.pdf"].check, got["5.pdf"].check, got["x.pdf"].check, got["y.pdf"].check) == ("fields filled one at a time", "ok", "encrypted", None)


class Image:
    """Stands in for the imaging library."""

    def __init__(self, width=100):
        self.width, self.done = width, []

    def convert(self, mode):
        return self

    def resize(self, size):
        return Image(size[0])

    @property
    def height(self):
        return 50


def stand_ins(monkeypatch, pages=(), readings=None, password=False):
    import sys
    import types

    readings, opened = readings or {}, []
    ocr = types.ModuleType("pytesseract")
    ocr.image_to_string = lambda image, config="": readings.get(config, "") if not isinstance(readings.get(config), Exception) else (_ for _ in ()).throw(readings[config])
    pil, heif, pdfium = types.ModuleType("PIL"), types.ModuleType("pillow_heif"), types.ModuleType("pypdfium2")

    def open_image(stream):
        if stream.read() == b"heic" and not opened:
            raise OSError("cannot identify image file")
        return Image()

    pil.Image = types.SimpleNamespace(open=open_image)
    pil.ImageOps = types.SimpleNamespace(exif_transpose=lambda x: x, autocontrast=lambda x: x)
    heif.register_heif_opener = lambda: opened.append(True)

    class Page:
        def __init__(self, text):
            self.text = text

        def get_textpage(self):
            return types.SimpleNamespace(get_text_range=lambda: self.text)

        def render(self, scale):
            assert scale == 300 / 72
            return types.SimpleNamespace(to_pil=Image)

    class PdfiumError(Exception):
        pass

    def pdf(content):
        if password or content == b"broken":
            raise PdfiumError("Incorrect password" if password else "Data format error")
        return [Page(p) for p in pages]

    pdfium.PdfiumError, pdfium.PdfDocument = PdfiumError, pdf
    for name, module in {"pytesseract": ocr, "PIL": pil, "pillow_heif": heif, "pypdfium2": pdfium}.items():
        monkeypatch.setitem(sys.modules, name, module)


def test_pdf_pages_are_read_or_recognised(monkeypatch):
    whole = "x" * 60
    stand_ins(monkeypatch, [whole, "short", whole, whole, whole], {"": "scan", "--psm 6": "a longer scan"})
    assert extract.document(b"%PDF", "a.PDF") == (f"--- page 1 ---\n{whole}\n--- page 2 ---\na longer scan\n--- page 3 ---\n{whole}\n--- page 4 ---\n{whole}", 5, 1, "ok", None)
    stand_ins(monkeypatch, ["short"], {"": "y" * 700, "--psm 6": "z" * 900})
    assert extract.document(b"%PDF", "a.pdf")[0].endswith("y" * 700)
    stand_ins(monkeypatch, ["short"], {"": RuntimeError("no engine")})
    assert extract.document(b"%PDF", "a.pdf") == ("--- page 1 ---\n", 1, 0, "ok", None)
    stand_ins(monkeypatch, password=True)
    assert extract.document(b"%PDF", "a.pdf") == ("", 0, 0, "encrypted", None)
    stand_ins(monkeypatch)
    assert extract.document(b"broken", "a.pdf") == ("", 0, 0, "unreadable", "PdfiumError: Data format error")


def test_photos_of_phones_are_read(monkeypatch):
    import sys

    stand_ins(monkeypatch, readings={"--psm 4": "a bill"})
    for name in ("a.jpg", "a.heic", "a.HEIF"):
        assert extract.document(b"heic", name) == ("--- page 1 ---\na bill", 1, 1, "ok", None)
    stand_ins(monkeypatch)
    monkeypatch.setitem(sys.modules, "pillow_heif", None)
    assert extract.document(b"heic", "a.heic")[3:] == ("unreadable", "OSError: cannot identify image file")


def test_failed_reads_say_why(spark, folder):
    texts = stages.extracted(spark, str(folder / "in"))
    row = extract.failed_reads(texts).first()
    assert (row.status, row.n) == ("unreadable", 1) and row.error.startswith("UnicodeDecodeError")


@pytest.fixture
def server():
    """A completion server that answers in pieces; its first answer is that it is busy."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def reply(self, status, body):
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self.reply(200, b"{}")

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.client_address, body))
            if len(seen) == 1:
                return self.reply(503, b"busy")
            if self.path == "/apply-template":
                return self.reply(200, json.dumps({"prompt": body["messages"][-1]["content"]}).encode())
            pieces = [b'data: {"content": "%s"}\n\n' % c for c in (b"a", b"b", b"c")] + [b'data: {"content": "", "stop": true}\n\n']
            return self.reply(200, b"".join(pieces)) if body["prompt"] != "no" else self.reply(400, b"bad")

        def log_message(self, *_):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", seen
    running.shutdown()


def test_http_backend(server):
    url, seen = server
    backend = model.HttpBackend(url)
    backend.PAUSE = 0
    assert backend.healthy() and not model.HttpBackend("http://127.0.0.1:9").healthy()
    assert backend.prompt([{"role": "user", "content": "hello"}]) == "hello"
    assert model.generate(backend, "hello") == "abc" and model.generate(backend, "hello") == "abc"
    first = next(iter(backend.stream("hello", 5)))  # a stream that is left alone
    assert first == "a" and model.generate(backend, "again") == "abc"
    with pytest.raises(ValueError, match="400 bad"):
        model.generate(backend, "no")
    assert seen[0][0] == seen[1][0] == "/apply-template" and seen[-1][2]["temperature"] == 0
    assert len({address for _, address, _ in seen[1:4]}) == 1
    assert model.backend("rules") is model.RuleBackend
    with pytest.raises(ValueError):
        model.backend("none")


def test_teachers_keep_to_the_schema(spark):
    class Loose(model.RuleBackend):
        def answer(self, document):
            return super().answer(document) | ({"category": "Groceries"} if "Cafe" in document else {})

    rows = spark.createDataFrame([("1", "INVOICE\nAcme"), ("2", "INVOICE\nCafe")], "sha256 string, prepared string")
    assert {(r.sha256, r.status, r.error) for r in model.teach(rows, Loose).collect()} == {("1", "labelled", None), ("2", "FAILED", "category is wrong")}
    whole = dict.fromkeys(FIELDS) | {"is_invoice": True, "total": 5}
    assert model.violations(whole) == [] and model.violations([]) == ["not an object"]
    assert model.violations(whole | {"total": True, "more": 1}) == ["more is unknown", "total is wrong"]
    assert model.violations({k: v for k, v in whole.items() if k != "tax"}) == ["tax is missing"]


def test_tables_go_when_nothing_refers_to_them(spark):
    import os

    from paperledger.tables import Scratch, checkpoint_root, numbered, release

    root = checkpoint_root(spark).removeprefix("file:")
    left = lambda: sum(len(d) for p, d, _ in os.walk(root) if os.path.basename(p).startswith("tables-"))
    release(spark)
    before = left()
    derived = Scratch(spark)(spark.range(10)).where("id > 3").select((F.col("id") * 2).alias("x"))
    release(spark)
    assert left() == before + 1 and derived.count() == 6
    del derived
    release(spark)
    assert left() == before
    places = [(r.id, r.place) for r in numbered(spark.range(50).orderBy(F.desc("id"))).collect()]
    assert sorted(places, key=lambda x: x[1]) == [(49 - i, i + 1) for i in range(50)]
    assert numbered(spark.range(0)).count() == 0


def test_many_small_files_are_written_and_listed_by_few_tasks(spark, tmp_path):
    rows = [(f"a=1/b={i}", f"x{i}.txt", f"ü {i}\n") for i in range(60)]
    spark.sparkContext.setJobGroup("listed", "")
    try:
        assert sinks.write_texts(spark.createDataFrame(rows, "folder string, name string, value string").coalesce(1), f"file:{tmp_path}/out") == 60
        found = files.scan(spark, f"{tmp_path}/out", suffixes=False)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(k).numTasks for j in tracker.getJobIdsForGroup("listed") for k in tracker.getJobInfo(j).stageIds]
    assert max(tasks) == 4 * spark.sparkContext.defaultParallelism
    got = {(r.path.split("/out/")[1], bytes(r.content).decode()) for r in found.collect()}
    assert got == {(f"{a}/{b}", c) for a, b, c in rows}
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
