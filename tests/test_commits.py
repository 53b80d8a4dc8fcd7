"""The commit log, transactions of the store, and runs that break or are run again."""

import pytest
from pyspark.sql import functions as F

from billfold.plans import stages
from billfold.plans.stages import RunOptions
from billfold.sources.commits import Change, CommitLog, Conflict
from billfold.sources.store import BillingStore, Transaction, export_texts, read_texts


def invoice(number, *lines):
    return "\n".join([f"Invoice No: {number}", "Description Qty Amount", *lines, ""])


def docs_of(spark, texts):
    """Documents of texts by file stem."""
    rows = [(s, f"{s}.txt", f"/in/{s}.txt", s, ".txt", t) for s, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id string, file_name string, file_path string, file_stem string, ext string, text string")
    return docs.withColumn("file_hash", F.sha2("text", 256))


@pytest.fixture
def store(spark, tmp_path):
    return BillingStore(spark, str(tmp_path / "store"), verification_buckets=8)


def run(store, docs, batch, **options):
    return stages.run_stages(store, docs, options=RunOptions(batch=batch, run_ts="t", **options))


INGESTED = ("invoices", "rows", "failures")


def contents(store, *names):
    names = names or (*INGESTED, "cleaned", "items", "totals", "verification")
    return {n: sorted(map(str, store.read(n).collect())) for n in names}


A1, A2 = invoice("A-1", "Pen 3 9.90", "Sales Tax 1.00"), invoice("A-2", "Ink 5.00")
ONE, OTHER, NONE = {"a": A1, "b": A2}, {"a": invoice("A-1", "Pen 3 7.90"), "c": invoice("A-3", "Cap 2.00")}, {"d": "  \n"}


@pytest.mark.parametrize(("again", "files", "sums"), [(OTHER, "acyz", {"A-1": 11.9, "A-3": 2.0, "Z-9": 1.0}), (NONE, "yz", {"A-1": 4.0, "Z-9": 1.0})])
def test_a_batch_run_again_leaves_exactly_its_own_rows(spark, store, again, files, sums):
    other = {"z": invoice("A-1", "Box 4.00"), "y": invoice("Z-9", "Bag 1.00")}
    for name, texts in (("b1", ONE), ("b2", other), ("b1", again)):
        run(store, docs_of(spark, texts), name)
    for table in ("invoices", "rows", "cleaned", "items"):
        assert {r.file_name for r in store.read(table).collect()} == {f"{f}.txt" for f in files}, table
    found = {r.invoice_number.upper(): r.items_sum for r in store.read("verification").collect()}
    assert found == pytest.approx(sums) and store.read("failures").count() == len(NONE if again is NONE else ())
    assert store.read("totals").count() == 0  # the tax row was of the first run


def test_a_batch_without_any_row_is_done_once(spark, store, monkeypatch):
    run(store, docs_of(spark, NONE), "b1")
    assert store.batches("cleaned") == store.batches("items") == {"b1"}
    calls = []
    clean = stages.clean_rows
    monkeypatch.setattr(stages, "clean_rows", lambda *a: calls.append(a) or clean(*a))
    run(store, docs_of(spark, ONE), "b2")
    run(store, None, None, skip_extract=True)
    assert len(calls) == 1 and store.batches("cleaned") == {"b1", "b2"}


@pytest.mark.parametrize("broken", [1, 2, 3])
def test_readers_see_all_of_a_batch_or_nothing(spark, store, monkeypatch, broken):
    """The ingest breaks at its first, second or third write, and is run again."""
    stages.ingest(store, docs_of(spark, ONE), options=RunOptions(batch="b1", run_ts="t"))
    before = contents(store, *INGESTED)
    written = []
    write = Transaction.write

    def break_at(self, name, df, batch):
        written.append(name)
        if len(written) == broken:
            raise RuntimeError("broken")
        write(self, name, df, batch)

    monkeypatch.setattr(Transaction, "write", break_at)
    with pytest.raises(RuntimeError):
        stages.ingest(store, docs_of(spark, OTHER), options=RunOptions(batch="b2"))
    assert contents(store, *INGESTED) == before and len(written) == broken
    monkeypatch.undo()
    stages.ingest(store, docs_of(spark, OTHER), options=RunOptions(batch="b2"))
    assert store.read("rows").select("file_name").distinct().count() == 3  # a.txt has a row of that number already


def test_a_run_that_dies_before_its_commit_is_not_seen(spark, store, monkeypatch):
    stages.ingest(store, docs_of(spark, ONE), options=RunOptions(batch="b1", run_ts="t"))
    before, numbers = contents(store, *INGESTED), store.log._numbers()
    monkeypatch.setattr(CommitLog, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        stages.ingest(store, docs_of(spark, OTHER), options=RunOptions(batch="b2"))
    monkeypatch.undo()
    assert contents(store, *INGESTED) == before and store.log._numbers() == numbers


def test_only_touched_buckets_are_written(spark, store):
    many = {f"m{i}": invoice(f"M-{i}", f"Pen {i}.50") for i in range(60)}
    run(store, docs_of(spark, many), "b1")
    first = store.log.state().parts("verification")
    assert len(first) == 8 and sum(p.folder is not None for p in first.values()) == 8
    run(store, docs_of(spark, {"n": invoice("M-7", "Cap 2.00")}), "b2")
    second = store.log.state().parts("verification")
    moved = [b for b in first if first[b].folder != second[b].folder]
    number = spark.createDataFrame([("m-7",), ("M-7",)], "invoice_number string").select(stages.bucket_of(8).alias("b"))
    assert len(moved) == 1 and moved[0] in {r.b for r in number.collect()}
    wider = BillingStore(spark, store.root, verification_buckets=32)  # the number of buckets is the store's
    run(wider, docs_of(spark, {"o": invoice("M-8", "Cap 2.00")}), "b3")
    assert set(store.log.state().parts("verification")) == set(first)
    sums = {r.invoice_number.upper(): r.items_sum for r in store.read("verification").collect()}
    assert len(sums) == 60 and (sums["M-7"], sums["M-8"], sums["M-9"]) == (9.5, 10.5, 9.5)


def test_runs_that_meet_both_count(spark, store, monkeypatch):
    """While one run reconciles, another commits invoices of the same numbers."""
    run(store, docs_of(spark, ONE), "b1")
    meet = {"z": invoice("A-1", "Box 4.00")}
    reconcile, met = stages.reconcile, []

    def slow(items, totals):
        if not met:
            met.append(1)
            run(BillingStore(spark, store.root), docs_of(spark, meet), "b2")
        return reconcile(items, totals)

    monkeypatch.setattr(stages, "reconcile", slow)
    run(store, docs_of(spark, {"y": invoice("A-1", "Bag 1.00")}), "b3")
    sums = {r.invoice_number.upper(): r.items_sum for r in store.read("verification").collect()}
    assert sums == {"A-1": 9.9 + 4.0 + 1.0, "A-2": 5.0} or sums["A-1"] == pytest.approx(14.9)
    assert store.batches("items") == {"b1", "b2", "b3"}


def test_conflicts_and_numbers(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    start = log.state()
    assert start.version == -1
    states = [log.commit(log.state(), Change({"t": {f"b{i}": f"t/{i}"}}, {"t": {f"c{i}": "int"}} if i % 7 == 0 else {}, {"n": i})) for i in range(23)]
    now = log.state()
    assert now == states[-1] and now.version == 22 and len(now.parts("t")) == 23
    assert list(now.columns["t"]) == ["c0", "c7", "c14", "c21"] and now.settings == {"n": 22}
    assert log.commit(start, Change({"u": {"x": "u/x"}})).version == 23  # nothing it needs has changed
    for read, change in (({"t"}, {"v": {"x": None}}), ({("t", "b3")}, {"v": {"x": None}}), ((), {"t": {"b4": None}})):
        with pytest.raises(Conflict):
            log.commit(start, Change(change), read)
    assert log.commit(start, Change({"v": {"x": None}}), {("t", "new")}).parts("v")["x"].folder is None
    taken = log.state()
    assert not log._put(taken, Change())  # its number is there
    assert log.state() == taken


def test_replaced_folders_go_one_version_later(spark, store):
    df = spark.createDataFrame([("f", "e")], "file string, error string")
    folders = []
    for _ in range(3):
        store.write("failures", df, "b")
        folders.append(store.log.state().parts("failures")["b"].folder)
    there = [bool(store._paths(f"{store.root}/{f}")) for f in folders]
    assert there == [False, True, True] and store.read("failures").count() == 1


def test_columns_are_never_lost(spark, store):
    """Of older files beside the log, and of columns added later."""
    spark.createDataFrame([("f", "h", "x", 7)], "file_name string, file_hash string, remark string, pages int").write.parquet(store.path("invoices", "old"))
    stages.ingest(store, docs_of(spark, ONE), options=RunOptions(batch="b1"))
    rows = {r.file_hash[:1] == "h" and len(r.file_hash) == 1: r for r in store.read("invoices").collect()}
    assert (rows[True].remark, rows[True].pages, rows[True].invoice_number) == ("x", 7, None) and rows[False].remark is None
    store.add_columns("rows", "page_no int, raw_text string, `odd name` double")
    with store.transaction() as changes:
        wide = store.read("rows").withColumns({"page_no": F.lit(3), "odd name": F.lit(0.5), "unknown": F.lit(1)})
        changes.write("rows", wide.limit(1), "b2")
    back = store.read("rows")
    assert back.columns[-2:] == ["page_no", "odd name"] and "unknown" not in back.columns
    assert sorted((r.page_no, r["odd name"]) for r in back.where("page_no is not null").collect()) == [(3, 0.5)]
    stages.ingest(store, docs_of(spark, {"n": invoice("N-1", "Cap 2.00")}), options=RunOptions(batch="b3"))
    assert store.read("rows").where("page_no is null").count() == back.count()


def test_texts_as_files(spark, tmp_path):
    texts = spark.createDataFrame([("two words", "a\n\nb\n"), ("two words", "other"), ("x=y", ""), ("n", None)], "file_stem string, text string")
    export_texts(texts, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "file_stem=two words").glob("*.txt"))) == 2
    back = sorted((r.file_stem, r.text) for r in read_texts(spark, str(tmp_path / "out")).collect())
    assert back == [("n", ""), ("two words", "a\n\nb\n"), ("two words", "other"), ("x=y", "")]
