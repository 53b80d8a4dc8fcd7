"""Files, store, stages and streams, end to end on small folders."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.plans import stages
from billfold.plans.stages import PageInputs, RunOptions
from billfold.sources import files
from billfold.sources.store import BillingStore, export_tables, scratch_folder
from billfold.streaming.ingest import ingest_stream, stream_documents

TWO_COLUMNS = """Harbour Salt INVOICE
BILL TO: SHIP TO:
Jane Roe Jane Roe
Qty Description Price Amount
Salt crystals 12.50 125.00
10
QX-00057
Subtotal 125.00
Sales Tax 12.50
Total Due 137.50
Due after 30 days
"""
GERMAN = """Werkstatt Nord
Invoice No Customer No Date
777 12345 1. März 2024
Amount
Base Charge 140,00 € 1 140,00 €
Call Charge 0,60 € 15 9,00 €
Total 149,00 €
VAT 19 % 28,31 €
This was generated by hand
Period: 01.02.2024
05.11.2033
"""


@pytest.fixture
def folder(tmp_path) -> Path:
    (tmp_path / "two.txt").write_text(TWO_COLUMNS, encoding="utf-8")
    (tmp_path / "german.TXT").write_bytes(GERMAN.replace("€", "EUR").replace("\n", "\r\n").encode("latin-1"))
    (tmp_path / "copy.txt").write_text(TWO_COLUMNS, encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "mixed.Txt").write_text("x", encoding="utf-8")
    (tmp_path / "other.tif").write_text("x", encoding="utf-8")
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "deep.txt").write_text("x", encoding="utf-8")
    return tmp_path


def docs_of(spark, folder):
    return files.read_documents(files.scan_files(spark, str(folder)))


def test_scan_files(spark, folder):
    scanned = files.scan_files(spark, str(folder))
    names = {r.file_name: (r.file_stem, r.ext) for r in scanned.collect()}
    assert set(names) == {"two.txt", "german.TXT", "copy.txt", "blank.txt", "scan.pdf"}
    assert names["german.TXT"] == ("german", ".txt")
    paths = [r.file_path for r in files.sorted_paths(scanned).collect()]
    assert paths == sorted(paths) and len(paths) == 5


def test_read_documents(spark, folder):
    docs = {r.file_name: r for r in docs_of(spark, folder).collect()}
    assert docs["two.txt"].text == TWO_COLUMNS
    assert docs["german.TXT"].text == GERMAN.replace("€", "EUR")  # Latin-1, line ends folded
    assert docs["two.txt"].file_hash == docs["copy.txt"].file_hash
    assert docs["scan.pdf"].text is None
    good, failed = files.split_failures(docs_of(spark, folder))
    assert good.count() == 3
    assert {r.error for r in failed.collect()} == {"No text extracted"}


def test_too_large_files_are_reported(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 5)
    docs = docs_of(spark, folder)
    good, failed = files.split_failures(docs)
    errors = [r.error for r in failed.collect()]  # the blank file and the scan are small enough
    assert good.count() == 0 and sorted(errors) == ["File too large to be read"] * 3 + ["No text extracted"] * 2


def test_unread_pages_are_failures_and_none_is_lost(spark, tmp_path):
    docs, pages = scanned(spark)
    docs = docs.withColumn("file_hash", F.when(F.col("ext") != ".pdf", F.col("file_hash")))
    n_pdf, n_other = (docs.where(c).count() for c in ("ext = '.pdf'", "ext <> '.pdf'"))
    store = BillingStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        stages.ingest(store, docs, pages, RunOptions(run_ts="t"))
    failures = store.read("failures").where("error = 'File too large to be read'")
    assert n_pdf >= 3 and failures.count() == n_pdf
    assert store.read("invoices").where("file_hash is null").count() == 0
    assert store.read("invoices").count() + store.read("failures").count() >= n_pdf + n_other


def test_text_dump_keeps_earlier_batches(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    docs, debug = docs_of(spark, folder), str(tmp_path / "debug")
    for batch, name in (("a", "two.txt"), ("b", "german.TXT"), ("b", "german.TXT")):
        stages.ingest(store, docs.where(F.col("file_name") == name), options=RunOptions(batch=batch, debug_path=debug))
    assert sorted(r.file_stem for r in spark.read.parquet(debug).collect()) == ["german", "two"]


def test_only_new_batches_are_cleaned_and_touched_invoices_reconciled(spark, folder, tmp_path, monkeypatch):
    store, docs = BillingStore(spark, str(tmp_path / "store")), docs_of(spark, folder)
    whole = BillingStore(spark, str(tmp_path / "whole"))
    want = stages.run_stages(whole, docs, options=RunOptions(run_ts="t"))
    seen = []
    clean = stages.clean_rows
    monkeypatch.setattr(stages, "clean_rows", lambda rows, *c: seen.append(sorted({r.batch for r in rows.collect()})) or clean(rows, *c))
    for batch, name in (("a", "two.txt"), ("b", "german.TXT"), ("c", "copy.txt")):
        out = stages.run_stages(store, docs.where(F.col("file_name") == name), options=RunOptions(batch=batch, run_ts="t", force=True))
    assert seen == [["a"], ["b"], ["c"]]
    for name in ("items", "totals", "verification"):
        got = sorted(map(str, out[name].drop("file_name").collect()))
        assert got == sorted(map(str, want[name].drop("file_name").collect()))
    assert out["verification"].count() == out["verification"].select("invoice_number").distinct().count()


def test_a_broken_replacement_leaves_the_version_before(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    store.ensure("reconciled")
    one, two = (spark.createDataFrame([(v,)], "done boolean") for v in (True, False))
    store.replace("reconciled", one)
    broken = two.withColumn("done", F.raise_error("broken").cast("boolean"))
    with pytest.raises(Exception, match="broken"):
        store.replace("reconciled", broken)
    assert store.read("reconciled").collect() == one.collect()
    store.replace("reconciled", two)
    store.replace("reconciled", two)
    assert store.read("reconciled").collect() == two.collect() and len(store.batches("reconciled")) == 2


def test_failures_are_listed_once(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    for _ in range(3):
        stages.ingest(store, docs_of(spark, folder))
    failed = [tuple(r) for r in store.read("failures").collect()]
    assert len(failed) == len(set(failed)) == 2


def test_bytes_are_read_once(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    staged = store.stage(docs_of(spark, folder))
    plan = stages.skip_seen(staged, spark.createDataFrame([("x",)], "file_hash string"))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "content" not in plan


def test_exports_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([(f"N{i % 7}", f"f{i % 3}", i) for i in range(50)], "invoice_number string, file_name string, row_number int")
    export_tables({"t": df.repartition(5)}, str(tmp_path), "json")
    parts = sorted((tmp_path / "t").glob("*.json"))
    rows = [json.loads(line) for p in parts for line in p.read_text(encoding="utf-8").splitlines()]
    keys = [(r["invoice_number"], r["file_name"], r["row_number"]) for r in rows]
    assert len(keys) == 50 and keys == sorted(keys)


def test_decode_keeps_a_byte_order_mark(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\rb"),), (bytearray(b"\xff\xe9"),)], "c binary")
    assert [r[0] for r in df.select(files.decode_text(F.col("c"))).collect()] == ["﻿a\nb", "ÿé"]


def test_unsupported_extension(spark):
    docs = spark.createDataFrame([("f.docx", ".docx", "x")], "file_path string, ext string, text string")
    assert files.split_failures(docs)[1].first().error == "Unsupported extension .docx"


def test_extract_golden(spark, folder):
    docs = docs_of(spark, folder).where(F.col("file_name").isin("two.txt", "german.TXT"))
    found = stages.extract(docs, min_confidence=50.0, run_ts="2024-05-05 00:00:00")
    two, german = found.invoices.orderBy(F.desc("file_name")).collect()
    assert (two.invoice_number, two.invoice_to, two.invoice_from, two.address) == ("INV_two", "ship to:", "", "")
    assert (two.table_data_count, two.avg_confidence, two.low_confidence_flag) == (5, None, False)
    assert german.invoice_number == "customer_no_date"
    rows = {}
    for r in found.rows.orderBy("row_number").collect():
        rows.setdefault(r.file_name, []).append(r.raw_text)
    # "Subtotal" and "Total Due" count as headers; "Due after" is a row until cleaning
    assert rows["two.txt"] == [
        "Salt crystals 12.50 125.00", "10", "QX-00057", "Sales Tax 12.50", "Due after 30 days",
    ]
    # "generated" hides the header word "rate"
    assert rows["german.TXT"] == [
        "Base Charge 140,00 EUR 1 140,00 EUR", "Call Charge 0,60 EUR 15 9,00 EUR", "VAT 19 % 28,31 EUR",
        "Period: 01.02.2024", "05.11.2033",
    ]


def run(spark, folder, store, **options):
    return stages.run_stages(store, docs_of(spark, folder), options=RunOptions(run_ts="2024-05-05 00:00:00", **options))


def test_run_twice_adds_nothing(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    first = run(spark, folder, store)
    invoices, rows = first["invoices"].count(), first["rows"].count()
    assert invoices == 2  # the copy and the blank file give none
    assert first["rows"].select("file_name").distinct().count() == 3  # but the copy gives rows
    verification = sorted(first["verification"].collect())
    second = run(spark, folder, store)
    assert (second["invoices"].count(), second["rows"].count()) == (invoices, rows)
    assert sorted(second["verification"].collect()) == verification
    third = run(spark, folder, store, force=True)
    assert (third["invoices"].count(), third["rows"].count()) == (invoices, rows)


def test_verification_of_a_run(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    out = run(spark, folder, store)
    ver = {r.invoice_number: r for r in out["verification"].collect()}
    assert set(ver) == {"INV_two", "INV_copy", "customer_no_date"}
    two, german = ver["INV_two"], ver["customer_no_date"]
    assert (two.items_sum, two.parsed_tax, two.parsed_total) == (125.0 + 10 + 57, 12.5, 204.5)
    assert not two.mismatch_flag and two.items_sum == two.parsed_subtotal
    assert (german.items_sum, german.parsed_tax) == (140 + 9 + 2.2024 + 2033, None)
    assert out["cleaned"].where(F.lower("description").contains("due")).count() == 0
    assert out["items"].count() + out["totals"].count() == out["cleaned"].count()


def test_stages_can_be_skipped(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    assert set(run(spark, folder, store, skip_clean=True, skip_post=True)) == {"invoices", "rows", "failures"}
    later = stages.run_stages(store, options=RunOptions(skip_extract=True))
    assert later["verification"].count() == 3
    with pytest.raises(ValueError):
        stages.run_stages(store)


def test_empty_store_gives_empty_tables(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    out = stages.run_stages(store, options=RunOptions(skip_extract=True))
    assert {n: df.count() for n, df in out.items()} == {"cleaned": 0, "items": 0, "totals": 0, "verification": 0}


def test_older_store_files_lack_columns(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    spark.createDataFrame([("f", "h")], "file_name string, file_hash string").write.parquet(store.path("invoices", "old"))
    row = store.read("invoices").first()
    assert (row.file_hash, row.avg_confidence) == ("h", None)


def test_batch_replaces_itself(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        stages.ingest(store, docs_of(spark, folder), options=RunOptions(batch="b1"))
    assert store.read("invoices").count() == 2
    assert store.read("failures").count() == 2


def test_exports(spark, folder, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    out = run(
        spark, folder, store,
        export_path=str(tmp_path / "out"), json_path=str(tmp_path / "json"), debug_path=str(tmp_path / "debug"),
    )
    assert spark.read.parquet(str(tmp_path / "out" / "invoices")).count() == 2
    objects = [
        json.loads(line)
        for part in (tmp_path / "json" / "by_invoice").glob("*.json")
        for line in part.read_text(encoding="utf-8").splitlines()
    ]
    assert {o["invoice_number"] for o in objects} == {"INV_two", "INV_copy", "customer_no_date"}
    assert all(set(o) == {"invoice_number", "file_name", "items", "totals", "verification"} for o in objects)
    dumped = {r.file_stem: r.text for r in spark.read.parquet(str(tmp_path / "debug")).collect()}
    assert dumped["two"] == TWO_COLUMNS and "blank" not in dumped
    assert not any((tmp_path / "store" / "staging").iterdir())
    export_tables({"rows": out["rows"]}, str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv" / "rows"), header=True)
    assert back.count() == out["rows"].count()


def test_stream_takes_new_files_only(spark, folder, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")
    store = BillingStore(spark, str(work / "store"))

    def go():
        ingest_stream(stream_documents(spark, str(folder), 2), store, str(work / "checkpoint")).awaitTermination()
        return store.read("invoices").count(), store.read("rows").select("file_name").distinct().count()

    first = go()
    assert first[0] == 2
    assert go() == first
    (folder / "new.txt").write_text(TWO_COLUMNS + "9 more\n", encoding="utf-8")
    assert go()[0] == 3


PAGE = "doc_id string, page_no int, text string"
WORDS = (
    "doc_id string, page_num int, block_num int, par_num int, line_num int, word_idx int, "
    "left int, top int, height int, text string, conf double"
)
CELLS = "doc_id string, page_num int, x int, y int, w int, h int, text string, confs array<double>"


def scanned(spark):
    def doc(name):
        stem, ext = name.split(".")
        return (name, name, f"/in/{name}", stem, f".{ext}", f"hash-{name}", None)

    docs = spark.createDataFrame(
        [doc(n) for n in ("tables.pdf", "cells.pdf", "words.pdf", "text.pdf", "none.pdf", "pic.png")],
        "doc_id string, file_name string, file_path string, file_stem string, ext string, file_hash string, text string",
    )
    page_text = [("tables.pdf", 1, "Invoice No: 5"), ("text.pdf", 1, "Item\nPen 3"), ("words.pdf", 1, "has text")]
    ocr = [(d, p, f"ocr {d} {p}") for d in ("tables.pdf", "cells.pdf", "words.pdf", "text.pdf", "pic.png") for p in (1, 2)]
    ocr = [o for o in ocr if o[0] != "pic.png" or o[1] == 1] + [("none.pdf", 1, " ")]

    def word(d, page, line, idx, text, conf):
        return (d, page, 1, 1, line, idx, idx, line * 20, 12, text, conf)

    words = [
        word("tables.pdf", 1, 1, 0, "unused", 10.0),
        word("words.pdf", 1, 1, 0, " ", -1.0),
        word("words.pdf", 2, 1, 0, "no", 80.0),
        word("words.pdf", 2, 1, 1, "digits", 60.0),
        word("words.pdf", 2, 2, 0, "7", -1.0),
        word("words.pdf", 3, 1, 0, "late", 1.0),
        word("cells.pdf", 1, 1, 0, "ignored", 5.0),
        word("pic.png", 1, 1, 0, "A", -1.0),
        word("pic.png", 1, 1, 1, "9", -1.0),
    ]
    cells = [
        ("cells.pdf", 1, 200, 100, 50, 50, "b", [90.0, -1.0]),
        ("cells.pdf", 1, 100, 104, 50, 50, "a", [31.0]),
        ("cells.pdf", 1, 100, 150, 50, 50, " ", []),
        ("cells.pdf", 1, 100, 300, 10, 10, "small", [1.0]),
    ]
    tables = [("tables.pdf", 1, 1, [["h"], ["x", "1"]])]
    return docs, PageInputs(
        page_text=spark.createDataFrame(page_text, PAGE),
        page_tables=spark.createDataFrame(tables, "doc_id string, page_no int, table_no int, rows array<array<string>>"),
        ocr_pages=spark.createDataFrame(ocr, PAGE),
        words=spark.createDataFrame(words, WORDS),
        cells=spark.createDataFrame(cells, CELLS),
    )


def test_extract_scanned_files(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    docs, pages = scanned(spark)
    found = stages.extract(docs, pages, min_confidence=60.0, run_ts="t", stage=store.stage)
    rows = {}
    for r in found.rows.orderBy("row_number").collect():
        rows.setdefault(r.file_name, []).append((r.row_number, r.raw_text, r.invoice_number))
    assert rows == {
        "tables.pdf": [(1, "x | 1", "5")],
        "cells.pdf": [(1, "a | b", "INV_cells"), (2, "", "INV_cells")],
        "words.pdf": [(1, "no digits", "INV_words"), (2, "7", "INV_words")],
        "text.pdf": [(1, "Pen 3", "INV_text"), (2, "ocr text.pdf 1", "INV_text"), (3, "ocr text.pdf 2", "INV_text")],
        "pic.png": [(1, "A 9", "INV_pic")],
    }
    invoices = {r.file_name: r for r in found.invoices.collect()}
    confidence = {n: (r.avg_confidence, r.low_confidence_flag, r.table_data_count) for n, r in invoices.items()}
    assert confidence == {
        "tables.pdf": (None, False, 1),
        "cells.pdf": (40.0, True, 2),
        "words.pdf": (70.0, False, 2),
        "text.pdf": (None, False, 3),
        "pic.png": (-1.0, True, 1),
    }
    assert invoices["words.pdf"].raw_text_preview == "\nhas text\nocr words.pdf 1\nocr words.pdf 2"
    assert invoices["tables.pdf"].raw_text_preview == "\nInvoice No: 5"
    assert [tuple(r) for r in found.failures.collect()] == [("/in/none.pdf", "No text extracted")]


def test_scanned_run_keeps_cell_rows(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path / "store"))
    docs, pages = scanned(spark)
    out = stages.run_stages(store, docs, pages, RunOptions(run_ts="t"))
    assert out["rows"].count() == 9 and out["invoices"].count() == 5
    # the blank cell's text comes back from its cells; blank rows go when cleaning
    assert out["cleaned"].count() == 8


def test_scratch_folder_follows_the_session(spark):
    class Conf:
        @staticmethod
        def get(key, default):
            return "/shared/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf

    assert scratch_folder(Session).startswith("/shared/billfold-")
    Conf.get = staticmethod(lambda key, default: default)
    with pytest.raises(ValueError):
        scratch_folder(Session)
    assert scratch_folder(spark) != scratch_folder(spark)


def test_extension_glob():
    assert files.extension_glob().startswith("*.{") and "TXT" in files.extension_glob()
    assert set(K.SUPPORTED_EXTENSIONS) == {".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".txt"}
