from pyspark.sql import functions as F

from billfold.functions import numbers as N


QTY_RATE_AMOUNT_CASES = [
    ("Pen | 2 | 1.50 | 3.00", (2.0, 1.5, 3.0)),
    ("2 | 3.00", (None, None, 3.0)),
    ("Qty. 3 | 9.90 | 29.70 | x", (3.0, 9.9, 29.7)),
    ("Qty 1.2.3 | 9 | 9", (None, 9.0, 9.0)),
    ("27.08.2019 | 1 | 2 | 3", (None, None, None)),
    ("05.11.2033", (None, None, None)),
    ("due PO-1 27.09.2019", (None, None, 9.2019)),
    ("Fee -12.5", (None, None, 12.5)),
    ("Fee 0,58 €", (None, None, 58.0)),
    ("Fee 1.000,00 €", (None, None, 1.0)),
    ("-00057", (None, None, 57.0)),
    ("ends x", (None, None, None)),
    ("1 | 2 | 3 | 4", (None, None, 4.0)),
]


def test_qty_rate_amount(evaluate):
    got = [tuple(v) for v in evaluate(N.qty_rate_amount, [raw for raw, _ in QTY_RATE_AMOUNT_CASES])]
    assert got == [want for _, want in QTY_RATE_AMOUNT_CASES]


def test_last_number(evaluate):
    got = evaluate(N.last_number, ["1,207.68", "QX-00057", "x", "€ 5,5 z", "1.2.3", None])
    assert got == [68.0, -57.0, None, 5.5, 3.0, None]


def test_normalize_amount(evaluate):
    texts = ["1,234.56", "1.234,56", "130,00", "$ 7", "a 3 b -4.5", "", "x", None, "1.2,3.4"]
    assert evaluate(N.normalize_amount, texts) == [1234.56, 1234.56, 13000.0, 7.0, -4.5, None, None, None, 4.0]


def test_normalize_qty(evaluate):
    nums = [2.5, -2.5, 3.0, None, float("nan"), 1e18]
    assert evaluate(N.normalize_qty, nums, "double") == [2.0, -2.0, 3.0, None, None, 1e18]


def test_normalize_qty_text(evaluate):
    texts = ["2,5", "2.5", "3", " 4 ", "-5", "1e3", "12d", "", None, "-2,5"]
    assert evaluate(N.normalize_qty_text, texts) == [2.5, 2.5, 3.0, 4.0, -5.0, 1000.0, None, None, None, None]


def test_summary_words(evaluate):
    rows = ["Elevator", "residue", "Sales Tax 3", "Pen"]
    assert evaluate(N.is_summary_row, rows) == [True, True, False, False]
    names = ["SUBTOTAL", "Sales Tax", "VAT", "Grand Total", "Amount due", "gst", None, "due"]
    assert evaluate(N.is_summary_description, names) == [True] * 6 + [False, False]
    assert evaluate(N.summary_type, names[:6]) == ["subtotal", "tax", "tax", "total", "total", "tax"]


def test_low_confidence(evaluate):
    flag = lambda c: N.is_low_confidence(c, 60.0)
    assert evaluate(flag, [59.9, 60.0, None], "double") == [True, False, False]
    assert evaluate(lambda c: N.is_low_confidence(c, None) | c.isNull() & F.lit(False), [1.0], "double") == [False]


def test_amount_falls_back_to_description(spark):
    df = spark.createDataFrame([(1.0, "x 9"), (None, "x 9"), (float("nan"), "-3")], "a double, d string")
    got = [r[0] for r in df.select(N.amount_or_description(F.col("a"), F.col("d"))).collect()]
    assert got == [1.0, 9.0, -3.0]
