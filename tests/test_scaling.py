"""What the operators shuffle, read and write, beside their rows."""

import re

from pyspark.sql import functions as F

from billfold.functions import text as T
from billfold.operators import grouping, layout, merge, reconcile, tables
from billfold.plans import stages
from billfold.sources import text_files
from billfold.sources.store import BillingStore, Transaction, export_tables, export_texts, read_texts
from billfold.workloads import fixtures as X
from billfold.workloads import queries as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_aggregate(df):
    text = plan(df)
    return text[text.index("Aggregate [") :].split("\n", 1)[1]


def line_items(spark, folder):
    rows = [(k, n, 10 * k + n, 7, 3.0, 12.34 * n) for k in (1, 2, 3) for n in (1, 2)] + [(1, 1, 22, 7, 2.0, 5.0)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, k % 2, 99.5) for k in (1, 2, 3)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(
        f"{folder}/orders.parquet"
    )
    spark.createDataFrame([(0, "C0"), (1, "C1")], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_a_text_file_has_no_checksum_file(spark, tmp_path):
    export_texts(spark.createDataFrame([("a", "x\n"), ("b", None)], "file_stem string, text string"), str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("file_stem=*/.*.crc"))
    assert sorted(map(tuple, read_texts(spark, str(tmp_path / "out")).collect())) == [("a", "x\n"), ("b", "")]


def test_text_files_are_made_and_read_by_tasks(spark, tmp_path):
    """In the layout of Spark's writer, without Hadoop's calls and their process for the mode of each file."""
    rows = [("two words", "a"), ("two words", "b\n"), ("x=y/z %41", ""), ("", "no stem"), (None, None), ("\u00e4\u4e2d", "\u00e4"), ("c", "\n")]
    texts = spark.createDataFrame(rows, "file_stem string, text string").repartition(3)
    export_texts(texts, str(tmp_path / "out"))
    export_texts(texts, f"file://{tmp_path}/out")  # a second export replaces the first
    texts.selectExpr("file_stem", "coalesce(text, '') as value").write.partitionBy("file_stem").text(str(tmp_path / "spark"))
    ours, sparks = ({p.name for p in (tmp_path / d).glob("*=*") if p.name.isascii()} for d in ("out", "spark"))
    assert len(ours) == 4 and ours == {name for name in sparks if "?" not in name}  # a JVM may have no name for other letters
    assert sorted(p.name for p in (tmp_path / "out").glob("[_.]*")) == ["_SUCCESS"]
    back = read_texts(spark, str(tmp_path / "out"))
    assert "MapInArrow" in plan(back) and plan(back).split()[-2] == "LocalRelation"
    want = [(stem or None, text or "") for stem, text in rows]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(want, key=str)
    export_texts(texts.where("false"), str(tmp_path / "out"))
    assert read_texts(spark, str(tmp_path / "out")).count() == 0


def test_moving_text_files_can_be_taken_up_again(tmp_path):
    for draft, stem in (("7", "a"), ("7", "b"), ("8", "a")):
        (tmp_path / "_temporary" / draft / f"file_stem={stem}").mkdir(parents=True)
        (tmp_path / "_temporary" / draft / f"file_stem={stem}" / f"part-{draft}.txt").write_text(draft)
    text_files._publish(f"{tmp_path}/_temporary/7")
    for draft in ("7", "8"):
        text_files._publish(f"{tmp_path}/_temporary/{draft}")
    assert sorted(f"{p.parent.name}/{p.name}" for p in tmp_path.glob("file_stem=*/*")) == [
        "file_stem=a/part-7.txt", "file_stem=a/part-8.txt", "file_stem=b/part-7.txt"
    ]


def test_keep_first_reads_its_rows_once(spark, tmp_path):
    rows = [("a", 1, 2), ("a", 1, 1), ("a", None, 3), ("a", None, 3), (None, None, 4)]
    spark.createDataFrame(rows, "k string, m int, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = grouping.keep_first(df, ["k", "m"], ["n"])
    assert first.columns == df.columns and plan(first).count("Relation [") == 1
    assert sorted(map(str, first.collect())) == sorted(
        map(str, spark.createDataFrame([rows[1], *rows[2:]], df.schema).collect())
    )


def test_inserted_rows_are_parsed_once(spark, tmp_path, monkeypatch):
    seen = []
    real = merge.merge_ignore
    monkeypatch.setattr(Q.merge, "merge_ignore", lambda stored, rows, *a: seen.append((stored, rows)) or real(stored, rows, *a))
    got = Q.s11_insert_rows(spark, line_items(spark, tmp_path)).collect()
    assert all("Generate" not in plan(df) for df in seen[0])
    rows = {(r.file_name, r.row_number): r.raw_text for r in got}
    assert len(got) == len(rows) == 10 and rows["order_3.txt", 1] == "old" and rows["order_1.txt", 1] == "Part P11 | 3 | 4.11 | 12.34"


def test_low_segments_need_no_fold(spark):
    rows = [("d", 1, x, y, 5, 9, t) for x, y, t in ((0, 0, "a"), (9, 10, "b"), (5, 30, "c"), (1, 40, "d"), (2, 46, "e"), (3, None, "z"))]
    cells = spark.createDataFrame(rows, "doc_id string, page_num int, x int, y int, w int, h int, text string")
    lines = layout.rows_from_cells(cells)
    assert re.search(r"<= 10\) THEN array\(0, size\(boxes", plan(lines))
    # centres 30, 35; 46 is eleven below the last one
    assert sorted((r.line_start, r.raw_text) for r in lines.collect()) == [(0, "a | b"), (30, "d | c"), (46, "e")]


def test_words_are_gathered_by_column(spark):
    rows = [("d", 1, 1, 1, 1, i, left, t) for i, left, t in ((2, 5, "c"), (1, 5, "b"), (0, 9, "d"), (4, None, "a"), (None, 5, "x"))]
    words = spark.createDataFrame(
        rows, "doc_id string, page_num int, block_num int, par_num int, line_num int, word_idx int, left int, text string"
    )
    lines = layout.lines_from_words(words)
    assert not re.search(r"collect_list\((named_)?struct", plan(lines))
    assert [r.raw_text for r in lines.collect()] == ["a x b c d"]


def test_nested_rows_are_shuffled_without_their_keys(spark):
    cleaned = spark.createDataFrame(
        [("N", "b", 1.0, 2.0, 2.0, "f", 2), ("N", "a", None, 1.0, 1.0, "f", 1), ("N", "Total", None, None, 3.0, "f", 3)],
        "invoice_number string, description string, qty double, rate double, amount double, file_name string, row_number int",
    )
    nested = reconcile.nest_by_invoice(*stages.postprocess(cleaned))
    assert "struct(invoice_number" not in below_aggregate(nested.select("items", "totals"))
    (row,) = nested.collect()
    assert [tuple(i) for i in row["items"]] == [("N", "a", None, 1.0, 1.0, "f", 1), ("N", "b", 1.0, 2.0, 2.0, "f", 2)]
    assert [tuple(t) for t in row["totals"]] == [("N", "total", "Total", 3.0, "f", 3)]


def test_input_is_gathered_as_numbers(spark, tmp_path):
    folder = line_items(spark, tmp_path)
    pages = X.page_tables(spark, folder)
    assert "Part P" not in below_aggregate(pages)
    rows = {(r.doc_id, r.page_no): r.rows for r in pages.collect()}
    assert rows["1", 1][1:] == [[None if p % 11 == 0 else f" Part P{p}", q, r, f"{a} "] for p, q, r, a in ((11, "3", "4.11", "12.34"), (22, "2", "2.50", "5.00"))]
    texts = X.invoice_texts(spark, folder)
    text = texts.where(F.col("doc_id") == "order_2").first().text
    assert text.split("\n")[4:6] == ["Part P21 | 3 | 4.11 | 12.34", "Part P22 | 3 | 8.22 | 24.68"]


def test_boxes_of_a_page_become_rows_once(spark, tmp_path):
    words = [("d", p, 1, b, n, i, i, 0, 9, t, 1.0) for p in (1, 2) for b in (2, 1) for n in (2, 1) for i, t in enumerate(("p", f"{b}{n}"))]
    schema = "doc_id string, page_num int, block_num int, par_num int, line_num int, word_idx int, left int, top int, height int, text string, conf double"
    spark.createDataFrame(words, schema).write.parquet(f"{tmp_path}/words")
    cells = [("d", 3, x, y, 50, 50, f"c{x}") for y in (3000, 0, 40) for x in (1, 0)] + [(None, 3, 0, 0, 50, 50, "lost")]
    spark.createDataFrame(cells, "doc_id string, page_num int, x int, y int, w int, h int, text string").write.parquet(f"{tmp_path}/cells")
    rows = stages.page_rows(spark.read.parquet(f"{tmp_path}/words"), spark.read.parquet(f"{tmp_path}/cells"))
    assert plan(rows).count("Relation [") == 2
    got = sorted((r.page_num, r.row_number, r.raw_text) for r in rows.collect())
    lines = [(p, i, f"p {at}") for p in (1, 2) for i, at in enumerate(("11", "12", "21", "22"), 1)]
    assert got == lines + [(3, i, "c0 | c1") for i in (1, 2, 3)]
    places = spark.read.parquet(f"{tmp_path}/words").drop("block_num", "par_num", "line_num")
    assert plan(stages.page_rows(places, spark.read.parquet(f"{tmp_path}/cells"))).count("Relation [") == 2


def test_texts_are_split_at_single_characters(spark):
    texts = ["Qty | Rate\n\fPen | 2 | 3 \nrate 5\nTotal 9\n8 lost\r\nItem\n\tInk 7\n", "Item\nA 1\nbalance due\nAmount\nB 2", " ", None, "no 5"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = docs.select("i", T.table_rows(F.col("text")).alias("rows"))
    text = plan(rows.select("i", F.transform("rows", T.folded_row_cells)))
    singles = text.count(", \f, -1)") + text.count(",  , -1)")
    assert 0 < text.count("split(") == singles  # other patterns are compiled for every value
    assert [r.rows for r in rows.orderBy("i").collect()] == [["Pen | 2 | 3", "8 lost", "Ink 7"], ["A 1", "B 2"], [], [], []]


def test_rows_with_keys_of_their_own_are_not_shuffled(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path))
    schema = "k string, n int, p string"
    stored = store.stage(spark.createDataFrame([("a", 1, "old"), ("z", None, "old"), ("y", 1, "old"), ("y", 1, "old")], schema))
    rows = [("a", 1, "p"), ("b", 1, "q"), ("b", 1, "p"), ("b", 2, "p"), ("c", None, "p"), ("c", None, "q"), ("z", None, "p"), (None, None, "p"), ("d", 3, "p")]
    incoming = store.stage(spark.createDataFrame(rows, schema))
    want = merge.new_rows(stored, incoming, ["k", "n"], ["p"], null_keys=False)
    got = merge.new_rows(stored, incoming, ["k", "n"], ["p"], null_keys=False, stage=store.stage)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.k, r.n, r.p) for r in got.collect()} >= {("b", 1, "p"), ("b", 2, "p"), ("d", 3, "p")}
    shared = merge.shared_keys(stored, incoming, ["k", "n"])
    assert shared.columns == ["__key"] and shared.count() == 4  # of a 1, b 1, c and z
    alone = merge.new_rows(stored.where("k = 'y'"), incoming.where("k = 'b' and n = 2 or k = 'd'"), ["k", "n"], ["p"], False, store.stage)
    assert "Window" not in plan(alone) and "Join" not in plan(alone) and alone.count() == 2


def test_known_hashes_are_staged_before_the_texts_meet_them(spark, tmp_path):
    store = BillingStore(spark, str(tmp_path))
    docs, known = (store.stage(spark.createDataFrame([(h, h) for h in hashes], "file_hash string, text string")) for hashes in ("aabc", "bcx"))
    fresh = merge.skip_seen(docs, known, stage=store.stage)
    assert plan(fresh).count("Join") == 1 and [r.text for r in fresh.collect()] == ["a", "a"]


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().shuffleManager().shuffleBlockResolver().getStoredShuffles()
    before = held().size()
    kept = spark.range(1000).repartition(3)
    BillingStore(spark, str(tmp_path)).write("failures", kept.selectExpr("string(id) as file", "'e' as error"), "b")
    rows = spark.createDataFrame([("b", 1, ["x", None]), ("a", 2, []), ("a", 1, None)], "invoice_number string, row_number int, cols array<string>")
    export_tables({"rows": rows.repartition(3)}, str(tmp_path / "out"), "csv")
    lines = [line for p in sorted((tmp_path / "out" / "rows").glob("*.csv")) for line in p.read_text().splitlines()[1:]]
    assert lines == ["a,1,", "a,2,[]", 'b,1,"[""x"",null]"']
    assert held().size() <= before and kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was


def test_an_ingest_deletes_its_texts_before_it_writes_rows(spark, tmp_path, monkeypatch):
    store, seen = BillingStore(spark, str(tmp_path)), []
    real = Transaction.add_ignore
    monkeypatch.setattr(Transaction, "add_ignore", lambda self, *a: seen.append(list(tmp_path.glob("staged_documents/*"))) or real(self, *a))
    stages.ingest(store, X.invoice_texts(spark, line_items(spark, tmp_path / "in")).withColumn("file_hash", F.sha2("text", 256)))
    assert seen == [[], [], []] and store.read("invoices").count() == 3 and store.read("rows").count() == 10


def test_items_are_shuffled_as_numbers_and_once(spark, tmp_path):
    texts = X.invoice_texts(spark, line_items(spark, tmp_path))
    below = below_aggregate(texts)
    assert "concat_ws" not in below and plan(texts).index("l_orderkey") < plan(texts).index("o_custkey")
    got = {r.doc_id: r.text.split("\n")[4:-3] for r in texts.collect()}
    assert got["order_1"] == ["Part P11 | 3 | 4.11 | 12.34", "Part P22 | 2 | 2.50 | 5.00", "Part P12 | 3 | 8.22 | 24.68"]


def test_page_tables_are_read_once(spark, tmp_path):
    rows = [("d", 2, 1, [["h"], ["c"]]), ("d", 1, 2, [["h"], ["b"]]), ("d", 1, None, [["h"], ["a"], [None]]), ("d", None, 1, [["h"], ["x"]]), (None, 1, 1, [["h"], ["y"]])]
    spark.createDataFrame(rows, "doc_id string, page_no int, table_no int, rows array<array<string>>").write.parquet(str(tmp_path / "t"))
    flat = tables.flatten_page_tables(spark.read.parquet(str(tmp_path / "t")))
    assert plan(flat).count("Relation [") == 1 and "Join" not in plan(flat)
    assert sorted((r.doc_id, r.row_number, r.raw_text) for r in flat.collect()) == [("d", 2, "a"), ("d", 3, ""), ("d", 4, "b"), ("d", 5, "c")]


def test_words_of_scans_are_dealt_out_as_texts(spark, tmp_path):
    docs, pages = Q._page_inputs(spark, line_items(spark, tmp_path / "in"), BillingStore(spark, str(tmp_path / "store")))
    own = docs.select("doc_id", F.lit(1).alias("page_num")).hint("shuffle_hash")
    met = pages.words.join(own, ["doc_id", "page_num"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert met.index("ShuffledHashJoin") < met.index("Generate") < met.index("Exchange") and "SortMergeJoin" not in met
