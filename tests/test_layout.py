import random

from pyspark.sql import functions as F

from billfold.operators import layout

WORD = (
    "doc_id string, page_num int, block_num int, par_num int, line_num int, word_idx int, "
    "left int, top int, height int, text string, conf double"
)


def test_lines_by_layout_keys(spark):
    rows = [
        ("d", 1, 1, 1, 1, 0, 50, 0, 9, "world", 90.0),
        ("d", 1, 1, 1, 1, 1, 5, 0, 9, "hello", 80.0),
        ("d", 1, 1, 1, 2, 0, 5, 0, 9, " ", -1.0),
        ("d", 1, 1, 2, 1, 0, 5, 0, 9, "two", 70.0),
        ("d", 1, None, 2, 1, 0, 5, 0, 9, "lost", 70.0),
        ("d", 2, 1, 1, 1, 0, 5, 0, 9, "page", 60.0),
    ]
    words = spark.createDataFrame(rows, WORD)
    lines = layout.number_lines(layout.lines_from_words(words)).orderBy("page_num", "row_number")
    got = [(r.page_num, r.row_number, r.raw_text) for r in lines.collect()]
    assert got == [(1, 1, "hello world"), (1, 2, "two"), (2, 1, "page")]


def centres(spark, tops, height=10):
    """Line starts of words at these tops with the words of each line, one page."""
    rows = [("d", 1, 1, 1, 1, i, i, top, height, f"w{i}", 1.0) for i, top in enumerate(tops)]
    words = spark.createDataFrame(rows, WORD).drop("block_num", "par_num", "line_num").repartition(3)
    out = layout.lines_from_centres(words).collect()
    return {r.line_start - height / 2: [int(w[1:]) for w in r.raw_text.split()] for r in out}


def test_centres_worked_by_hand(spark):
    # a line's centre moves half of the way to each new word; a word 8 away still joins
    assert centres(spark, [0, 8, 12]) == {0.0: [0, 1, 2]}  # 0, 4, then 8 away
    assert centres(spark, [0, 8, 13]) == {0.0: [0, 1], 13.0: [2]}  # 4, then 9 away
    assert centres(spark, [0, 9]) == {0.0: [0], 9.0: [1]}
    assert centres(spark, [0, 0, 0, 8]) == {0.0: [0, 1, 2, 3]}
    assert centres(spark, [0, 6, 11, 15, 19, 23]) == {0.0: [0, 1, 2, 3, 4, 5]}  # 3, 7, 11, 15, 19: drifts along


def test_many_words_on_one_position(spark):
    # 3000 words at 8 bring the centre from 0 to 8 for all purposes, so 16 joins and 25 does not
    tops = [0] + [8] * 3000 + [16, 25]
    lines = centres(spark, tops)
    assert set(lines) == {0.0, 25.0} and len(lines[0.0]) == 3002
    cells = spark.createDataFrame([("d", 1, i, y, 50, 50, "c") for i, y in enumerate(tops)], CELL)
    # whole numbers: the centre stays at 7, halved downwards, so 16 is 9 away and within 10; then (7 + 16) // 2 = 11 and 25 is not
    assert sorted(r.line_start for r in layout.rows_from_cells(cells).collect()) == [0, 25]


CELL = "doc_id string, page_num int, x int, y int, w int, h int, text string"


def test_cells_worked_by_hand(spark):
    rows = [("d", 1, 9, 0, 50, 50, "b"), ("d", 1, 1, 10, 50, 50, "a"), ("d", 1, 5, 16, 50, 50, " "), ("d", 2, 0, 0, 50, 50, "p")]
    rows += [("d", 2, 0, 11, 50, 50, "q"), ("d", 2, 3, 15, 50, 50, "r")]
    out = layout.rows_from_cells(spark.createDataFrame(rows, CELL)).collect()
    got = {(r.page_num, r.line_start): (sorted(r.cols), sorted(r.raw_text.split(" | "))) for r in out}
    # 0 and 10 join at 5, 16 is 11 away; on page 2 11 is too far from 0, 15 joins it
    assert got == {
        (1, 0): (["a", "b"], ["a", "b"]), (1, 16): ([" "], [""]), (2, 0): (["p"], ["p"]), (2, 11): (["q", "r"], ["q", "r"]),
    }


def test_lines_do_not_depend_on_partitioning(spark):
    rng = random.Random(7)
    rows = [("d", p, 1, 1, 1, i, i, rng.randrange(200), 9, f"w{i}", 1.0) for p in range(30) for i in range(40)]
    words = spark.createDataFrame(rows, WORD).drop("block_num", "par_num", "line_num")
    one, many = (sorted(map(tuple, layout.lines_from_centres(words.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_cell_area_is_strict(spark):
    cells = spark.createDataFrame([(20, 50), (20, 51), (60_000, 60_000)], "w int, h int")
    assert layout.keep_cells(cells).count() == 2


def test_confidence(spark):
    rows = [
        ("d", 1, 1, 1, 1, 0, 0, 0, 9, "a", 90.0),
        ("d", 1, 1, 1, 1, 1, 0, 0, 9, "b", -1.0),
        ("d", 2, 1, 1, 1, 0, 0, 0, 9, "c", 30.0),
        ("d", 2, 1, 1, 1, 0, 0, 0, 9, "c", 50.0),
        ("e", 1, 1, 1, 1, 0, 0, 0, 9, "c", -1.0),
    ]
    words = spark.createDataFrame(rows, WORD)
    lines = {r.doc_id: r.avg_confidence for r in layout.avg_confidence(words).collect()}
    cells = {r.doc_id: r.avg_confidence for r in layout.avg_confidence(words, drop_missing=False).collect()}
    bare = {r.doc_id: r.avg_confidence for r in layout.avg_confidence(words.drop("conf")).collect()}
    assert lines == {"d": 65.0, "e": None}
    assert cells == {"d": 42.25, "e": -1.0}
    assert bare == {"d": 100.0, "e": 100.0}
    odd = words.withColumn("conf", F.lit("n/a"))
    assert layout.avg_confidence(odd).where("avg_confidence is not null").count() == 0
