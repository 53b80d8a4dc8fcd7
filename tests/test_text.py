from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions import text as T


def values(evaluate, keywords, texts):
    return evaluate(lambda c: T.value_after_keywords(c, keywords), texts)


def test_lines_fold_and_drop_blanks(evaluate):
    text = " a  b\t c \r\n\n\x0b d e  \x85f\x1fg "
    assert evaluate(T.text_lines, [text, "", " \n "]) == [["a b c", "d e", "f g"], [], []]


def test_strip_takes_unicode_blanks(evaluate):
    assert evaluate(T.strip, ["　 x  ", "\x1cy\n"]) == ["x", "y"]


SELLER_CASES = [
    ("From: ACME Corp\nTo: X", "acme corp"),
    ("SELLER Big Co\nfrom here", "here"),  # keyword order, not place in the text
    ("from\n\n  Next Line", "next line"),  # the value may stand on the next line
    ("from:", ":"),
    ("x from   ", ""),  # a hit without a value ends the search
    ("Xfrom - Late\nvendored", "Late"),  # no whole word: substring, original case
    ("afrom\nb vendorX : Rest -", "X : Rest"),
    ("nothing", ""),
    ("fréfrom Été", "Été"),
]


def test_seller(evaluate):
    got = values(evaluate, K.SELLER_KEYWORDS, [text for text, _ in SELLER_CASES])
    assert got == [want for _, want in SELLER_CASES]


def test_sign_keyword_needs_a_word_right_after(evaluate):
    got = values(evaluate, ("invoice#",), ["invoice#77 x", "invoice# 77", "invoice#"])
    assert got == ["77 x", "77", ""]


def test_second_pass_goes_line_by_line(evaluate):
    text = "xxzipyy one\nmycity two"
    assert values(evaluate, ("city", "zip"), [text]) == ["yy one"]
    assert values(evaluate, ("city", "zip"), ["a zipa mycityb"]) == ["b"]


ADDRESS_CASES = [
    ("see 12 Baker Road, London", "12 Baker Road"),
    ("see 12 Baker Street, London", ", london"),
    ("9 x 31 Mole Rd and 7 Long Lane now", "9 x 31 Mole Rd and 7 Long Lane"),
    ("44120 Foo\nBar, the best: 5 avenue", "44120 Foo\nBar, the best"),
    ("1234567 Main St", "34567 Main St"),
    ("5 st: 6 a st", "6 a st"),
    ("no digits best", ""),
    ("write to P.O. Box 7712 soon", "P.O. Box 7712"),
    ("x; Old Town,  Ham 59000.", "Old Town,  Ham 59000"),
    ("Address: Hall 3", "hall 3"),
]


def test_address(evaluate):
    got = evaluate(T.address, [text for text, _ in ADDRESS_CASES])
    assert got == [want for _, want in ADDRESS_CASES]


def test_address_is_linear_on_digits(evaluate):
    text = "12 34,5 " * 40_000
    assert evaluate(T.address, [text]) == [""]


CLEAN_INVOICE_NUMBER_CASES = [
    ("Invoice: A 17/3", "A_173"),
    ("invoice no 7", "no_7"),
    ("inv. 7", "_7"),
    ("INV-12", "12"),
    ("INV_12", "_12"),
    ("bill no: 5", "no_5"),
    ("", ""),
    ("invoice éé", "éé"),  # nothing left: the cut text itself
    ("x" * 200, "x" * 120),
]


def test_clean_invoice_number(evaluate):
    got = evaluate(T.clean_invoice_number, [raw for raw, _ in CLEAN_INVOICE_NUMBER_CASES])
    assert got == [want for _, want in CLEAN_INVOICE_NUMBER_CASES]


def test_invoice_number_sources(evaluate):
    texts = ["Invoice No. 1414\n", "ref inv-0099 ok", "xinv-1 y", "invoice no\n"]
    got = evaluate(lambda c: T.invoice_number(c, F.lit("stem")), texts)
    assert got == ["_1414", "0099", "INV_stem", "INV_stem"]


ROW_CELLS_CASES = [
    ("a | 1 | 2", ["a", "1", "2"]),
    ("a  b\tc", ["a", "b", "c"]),
    ("a | b", ["a | b"]),
    ("a |  | b", ["a", "b"]),
    ("Pen blue 3 1.50 4,50", ["Pen blue", "3", "1.50", "4,50"]),
    ("1 2 (3)", ["", "1", "2", "(3)"]),
    ("abc12 7", ["abc12", "7"]),
    ("", [""]),
    ("word", ["word"]),
    ("5 word", ["5 word"]),
]


def test_row_cells(evaluate):
    got = evaluate(T.row_cells, [row for row, _ in ROW_CELLS_CASES])
    assert got == [want for _, want in ROW_CELLS_CASES]


def test_long_numeric_row(evaluate):
    assert len(evaluate(T.row_cells, ["x " + "1 " * 50_000])[0]) == 50_001


def test_table_rows(evaluate):
    text = "\n".join(
        [
            "Early 1",
            "Qty Price",
            "Pen 2 3.00",
            "note",
            "Qty. 3 9.90",  # header word: not a row
            "Ink 1 4.00",
            "Balance Due 7.00",
            "After 9",
            "balance due amount",  # a header word makes it a header
            "Cap 8",
            "Grand Total 5",  # opens, never closes
            "Due 30 days",
            "balance dues 4",
        ]
    )
    rows = evaluate(T.table_rows, [text, "", "no table 5"])
    assert rows == [["Pen 2 3.00", "Ink 1 4.00", "Cap 8", "Due 30 days", "balance dues 4"], [], []]
