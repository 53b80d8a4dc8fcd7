import random

from pyspark.sql import functions as F

from billfold.operators import cleaning, fields, grouping, merge, tables
from billfold.sources import files


def test_page_tables(spark):
    rows = [
        ("d", 2, 1, [["h"], ["x", None, " y "]]),
        ("d", 1, 1, [["h1", "h2"], [None, "b"], ["", "c"]]),
        ("d", 1, 2, [[], ["first"], ["second"]]),  # an empty header row stays out of the count
        ("d", 3, 1, []),
        ("e", 1, 1, [["only header"]]),
    ]
    t = spark.createDataFrame(rows, "doc_id string, page_no int, table_no int, rows array<array<string>>")
    got = [tuple(r) for r in tables.flatten_page_tables(t).orderBy("doc_id", "row_number").collect()]
    assert got == [
        ("d", 1, "b", ["", "b"]),
        ("d", 2, " | c", ["", "c"]),
        ("d", 3, "", []),
        ("d", 4, "first", ["first"]),
        ("d", 5, "second", ["second"]),
        ("d", 6, "x | y", ["x", "", "y"]),
    ]


def test_row_numbers_over_blocks(spark):
    df = spark.range(500).selectExpr("id % 2 as k", "id div 40 as b", "id as o").repartition(5)
    got = grouping.number_rows(df, ["k"], ["b", "o"], block=["b"])
    assert got.where("row_number <> o div 2 + 1").count() == 0
    assert got.count() == 500


def test_source_choice(spark):
    def src(rows):
        return spark.createDataFrame(rows, "doc_id string, raw_text string")

    chosen = tables.choose_row_source([src([("a", "t")]), src([("a", "o"), ("b", "o")]), src([("b", "x"), ("c", "x")])])
    assert sorted(map(tuple, chosen.collect())) == [("a", "t", 1), ("b", "o", 2), ("c", "x", 3)]


def test_fallback_text(spark):
    docs = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", " "), ("d", None)], "doc_id string, text string")
    ocr = spark.createDataFrame([(d, p, f"{d}{p}") for d in "abcd" for p in (2, 1)], "doc_id string, page_no int, text string")
    found = spark.createDataFrame([("a",), ("c",)], "doc_id string")
    got = {r.doc_id: r.text for r in tables.append_fallback_text(docs, ocr, found).collect()}
    assert got == {"a": "A", "b": "B\nb1\nb2", "c": " \nc1\nc2", "d": "\nd1\nd2"}


def test_raw_text_from_cells(spark):
    cols = [f"v{i}" for i in range(1, 12)]
    df = spark.createDataFrame([("", cols), (None, ["", "x"]), ("kept", cols), ("", None)], "r string, c array<string>")
    got = [r[0] for r in df.select(tables.raw_text_or_cells(F.col("r"), F.col("c"))).collect()]
    assert got[0].split(" | ") == ["v1", "v10", "v11", *(f"v{i}" for i in range(2, 10))]
    assert got[1:] == ["x", "kept", ""]


def test_merge_ignore(spark):
    old = spark.createDataFrame([("k1", "old")], "k string, v string")
    new = spark.createDataFrame(
        [("k1", "new", 1), ("k2", "b", 2), ("k2", "a", 1), (None, "n1", 1), (None, "n2", 2)], "k string, v string, o int"
    )
    once = merge.merge_ignore(old, new, ["k"], ["o"])
    assert sorted(map(tuple, once.where("k is not null").collect())) == [("k1", "old"), ("k2", "a")]
    assert once.where("k is null").count() == 2  # null keys are never equal
    assert merge.merge_ignore(once.where("k is not null"), new.where("k is not null"), ["k"], ["o"]).count() == 2


def test_merge_takes_only_columns_of_the_table(spark):
    old = spark.createDataFrame([("k1", "x")], "k string, extra string")
    new = spark.createDataFrame([("k2", 1)], "k string, other int")
    got = merge.merge_ignore(old, new, ["k"], ["k"])
    assert got.columns == ["k", "extra"] and got.count() == 2


def test_evolve_schema(spark):
    df = merge.evolve_schema(spark.createDataFrame([(1, "x")], "a int, z string"), "a int, b double, c string")
    assert df.columns == ["a", "z", "b", "c"] and df.first().b is None


def test_skip_seen(spark):
    files = spark.createDataFrame([("h1", 1), ("h2", 2), ("h2", 3)], "file_hash string, n int")
    known = spark.createDataFrame([("h1",)], "file_hash string")
    assert merge.skip_seen(files, known).count() == 2
    assert merge.skip_seen(files, known, force=True).count() == 3
    assert merge.skip_seen(files, None).count() == 3


def test_clean(spark):
    rows = [
        ("N", "f", 1, "  Pen\n | 2 | 1.5 | 3 "),
        ("N", "f", 2, " "),
        ("N", "f", 3, None),
        ("N", "f", 4, "Elevator 9"),
        ("N", "f", 5, "Sales Tax 2.00"),
    ]
    got = cleaning.clean_rows(spark.createDataFrame(rows, "invoice_number string, file_name string, row_number int, raw_text string"))
    assert [tuple(r) for r in got.orderBy("row_number").collect()] == [
        ("N", "Pen", 2.0, 1.5, 3.0, "f", 1),
        ("N", "Sales Tax 2.00", None, None, 2.0, "f", 5),
    ]


def test_text_columns_are_parsed(spark):
    df = spark.createDataFrame(
        [("N", "Pen", "2,5", "1.234,5", "1,234.5", "f", 1)],
        "invoice_number string, description string, qty string, rate string, amount string, file_name string, row_number int",
    )
    row = cleaning.with_amounts(df).first()
    assert (row.qty, row.rate, row.amount) == (2.5, 1234.5, 1234.5)


def test_row_counts(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    rows = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    assert sorted(map(tuple, fields.row_counts(docs, rows).collect())) == [("a", 2), ("b", 0)]


def test_rows_of_parts_are_those_of_the_whole(spark):
    rng = random.Random(2)
    kinds = ["Item 3 | 4 | 5", "Qty and rate", "plain words", "7 apples", "Balance Due 9", "balance due", "", "  ", "Total 3", "x 1 2 y"]
    docs = [(f"d{i}", [rng.choice(kinds) for _ in range(rng.randrange(60))]) for i in range(60)]
    whole = spark.createDataFrame([(d, "\n".join(ls)) for d, ls in docs], "doc_id string, text string")
    want = sorted(tuple(r) for r in tables.document_rows(whole).select("doc_id", "row_number", "raw_text", "cols").collect())
    assert len(want) > 300
    for size in (1, 4, 100):
        parts = [(d, at * 10, "\n".join(ls[at : at + size])) for d, ls in docs for at in range(0, len(ls), size)]
        rng.shuffle(parts)
        splits = spark.createDataFrame(parts, "doc_id string, split_no bigint, text string").repartition(3)
        assert sorted(tuple(r) for r in tables.split_rows(splits).select("doc_id", "row_number", "raw_text", "cols").collect()) == want


def test_files_read_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SPLIT_LINES", 50)
    lines = [f"Item {i}" if i % 97 == 0 else f"Pen é {i} | {i % 5} | 9.90" if i % 61 else "Balance Due" for i in range(3000)]
    (tmp_path / "long.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "latin.txt").write_bytes("\r\n".join(lines[:700]).encode("latin-1"))
    (tmp_path / "one.txt").write_text("Item\nPen 1", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        splits = files.read_splits(spark, str(tmp_path))
        whole = files.read_documents(files.scan_files(spark, str(tmp_path)))
        got = tables.split_rows(splits).withColumn("name", F.substring_index("doc_id", "/", -1))
        rows = sorted(tuple(r) for r in got.select("name", "row_number", "raw_text").collect())
        parts = {r.file_name: r.n for r in splits.groupBy("file_name").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = tables.document_rows(whole.select("file_name", "text")).select("file_name", "row_number", "raw_text")
    assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) > 1000
    assert parts["long.txt"] > 15 and parts["latin.txt"] > 3 and parts["one.txt"] == 1
