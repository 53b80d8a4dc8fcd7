"""Column functions on document text: lines, labelled fields, row cells.

Everything here is a native Column expression. The patterns are written so that
each one is linear in the length of its text: a document that is one long run of
digits or blanks must not turn a regex quadratic.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from billfold.functions import constants as K


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it.

    Column expressions are trees: a sub-expression used twice is written twice, and
    inside conditions and lambdas nothing merges the copies again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Cut Unicode white space off both ends (SQL ``trim`` cuts blanks only)."""
    return F.btrim(col, F.lit(K.SPACE_CHARS))


def fold_spaces(col: Column) -> Column:
    """Every run of white space becomes one blank; both ends are stripped.

    Single blanks are not matched, so most text is passed on as it is.
    """
    return strip(F.regexp_replace(col, f"{K.SPACE}{{2,}}|[{K.SPACE_SET}&&[^ ]]", " "))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~col.rlike(K.NOT_SPACE), F.lit(True))


def contains_any(low: Column, words: Sequence[str]) -> Column:
    """True if the lower-case text holds any of the words as a substring.

    A chain of byte searches: far cheaper than one pattern with alternatives, which is
    tried word by word at every character.
    """
    return reduce(or_, (low.contains(w) for w in _needed(words)))


def _needed(words: Sequence[str]) -> list[str]:
    """The words without those that contain another one and so add nothing."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def has_digit(col: Column) -> Column:
    return col.rlike(K.DIGIT)


def _lines_joined(text: Column) -> Column:
    """The non-blank lines, white space folded, with one '\n' between them.

    Works on the text as a whole: two passes per text instead of several per line, and
    one cheap test instead of them where there is nothing to fold.
    """
    inline = K.INLINE_SPACE_SET
    folded = strip(F.regexp_replace(text, f"[{inline}]{{2,}}|[{inline}&&[^ ]]", " "))
    joined = F.regexp_replace(folded, f" ?[{K.LINE_END_SET}][ {K.LINE_END_SET}]*+", "\n")
    tidy = text.rlike(r"\A[!-~\p{L}]++(?:[ \n][!-~\p{L}]++)*+\z")
    return F.when(tidy, text).otherwise(joined)


def text_lines(text: Column) -> Column:
    """array<string>: the non-blank lines, white space folded."""
    return F.filter(F.split(_lines_joined(text), "\n", -1), lambda line: line != "")


# --- labelled values ------------------------------------------------------------

def _whole_word(keyword: str) -> str:
    """Pattern of the keyword between word boundaries on both of its sides.

    The test before the keyword looks back over it, so that it runs on hits only.
    """
    word = re.escape(keyword)
    before = "!" if keyword[0].isalnum() else "="
    after = "!" if keyword[-1].isalnum() else "="
    return f"{word}(?<{before}{K.WORD}{word})(?{after}{K.WORD})"


def _labelled(low: Column, keyword: str) -> Column:
    """Rest of the line after a whole-word keyword, or null if it does not occur.

    The captured group has one character at least, so an empty extract means "no
    hit" and a blank one means "hit without a value" (which ends the search with '').
    """
    pattern = rf"{_whole_word(keyword)}{K.SPACE}*[:\-]?{K.SPACE}*([^\n]+)"
    value = bind(
        F.regexp_extract(low, pattern, 1), lambda raw: F.when(raw != "", strip(raw))
    )
    return F.when(low.contains(keyword), value)


def _trailing(text: Column, keywords: Sequence[str]) -> Column:
    """Rest of the first line that holds a keyword anywhere and text after it.

    Within one line the keywords are tried in list order, each at its first place.
    """
    line_char = f"[^{K.LINE_END_SET}]"
    value_char = rf"[^{K.LINE_END_SET} :\t\-]"
    places = "|".join(f"{line_char}*?{re.escape(k)}" for k in keywords)
    pattern = (
        rf"(?i)(?:\A|(?<=[{K.LINE_END_SET}]))(?:{places})"
        rf"[ :\t\-]*+({value_char}(?:{line_char}*{value_char})?)"
    )
    return F.regexp_extract(text, pattern, 1)


def value_after_keywords(text: Column, keywords: Sequence[str], low: Column | None = None) -> Column:
    """The value that follows one of the keywords, '' if there is none.

    First every keyword as a whole word on the lower-case text, in list order; then,
    line by line, as a substring on the text itself. Texts without any keyword are
    sorted out by one alternation test before the dearer patterns run.
    """
    low = F.lower(text) if low is None else low
    hits = [_labelled(low, k) for k in keywords]
    found = F.coalesce(*hits, _trailing(text, keywords))
    return F.when(contains_any(low, keywords), found).otherwise(F.lit(""))


# --- addresses --------------------------------------------------------------------

def street_address(text: Column) -> Column:
    """House number ... street word, the longest reading of the first one; null if none.

    The pattern may run over line ends and up to the last street word of its run of
    plain characters. Trying that at every digit is quadratic on digit-rich texts, so
    the text is cut into runs first, each run is cut after its last street word, and
    only then is the start looked for: the first start fits nearly always.
    """
    plain = rf"{K.WORD_SET}{K.SPACE_SET}.,\-"
    initials = "".join(dict.fromkeys(w[0] for w in K.STREET_WORDS))
    street = f"(?=[{initials}])(?:" + "|".join(K.STREET_WORDS) + ")"
    runs = F.filter(
        F.split(text, f"[^{plain}]+", -1), lambda run: run.rlike(rf"{K.DIGIT}{K.SPACE}")
    )
    cut = F.transform(
        runs, lambda run: F.regexp_extract(run, rf"(?ius)\A.*{street}(?!{K.WORD})", 0)
    )
    found = F.transform(
        F.filter(cut, lambda run: run != ""),
        lambda run: F.regexp_extract(
            run, rf"(?iu){K.DIGIT}{{1,5}}{K.SPACE}+[{plain}]+{street}\z", 0
        ),
    )
    first = strip(F.get(F.filter(found, lambda hit: hit != ""), F.lit(0)))
    possible = text.rlike(rf"{K.DIGIT}{K.SPACE}") & text.rlike(rf"(?iu){street}(?!{K.WORD})")
    return F.when(possible, first)


def _first_match(text: Column, pattern: str) -> Column:
    return bind(F.regexp_extract(text, pattern, 0), lambda raw: F.when(raw != "", strip(raw)))


def post_box(text: Column) -> Column:
    return _first_match(text, rf"(?iu)P\.?O\.?{K.SPACE}*Box{K.SPACE}*{K.DIGIT}+")


def place_with_code(text: Column) -> Column:
    """Words, a comma, a place and a 5-6 digit code; tried at starts of word runs only."""
    word_or_space = f"[{K.WORD_SET}{K.SPACE_SET}]"
    code = rf",{K.SPACE}*[A-Za-z]{{2,}}{K.SPACE}*{K.DIGIT}{{5,6}}"
    place = _first_match(text, rf"(?iu)(?<!{word_or_space}){word_or_space}++{code}")
    return F.when(text.rlike(f"(?iu){code}"), place)


def _or_else(value: Column, *others: Column) -> Column:
    """The value unless it is '', else the first of the others that is not null."""
    return bind(value, lambda v: F.coalesce(F.when(v != "", v), *others))


def address(text: Column, low: Column | None = None) -> Column:
    return _or_else(
        value_after_keywords(text, K.ADDRESS_KEYWORDS, low),
        street_address(text),
        post_box(text),
        place_with_code(text),
        F.lit(""),
    )


# --- invoice numbers ----------------------------------------------------------------

def clean_invoice_number(raw: Column) -> Column:
    """One leading label cut, white space to '_', other signs dropped, 120 characters."""
    labels = "|".join(re.escape(p) for p in K.INVOICE_NUMBER_PREFIXES)

    def tidy(cut: Column) -> Column:
        plain = F.regexp_replace(
            F.regexp_replace(cut, f"{K.SPACE}+", "_"), r"[^A-Za-z0-9\-_#]", ""
        )
        return _or_else(F.substring(plain, 1, K.INVOICE_NUMBER_LENGTH), cut, F.lit(""))

    cut = F.regexp_replace(strip(raw), rf"(?iu)\A(?:{labels})[:{K.SPACE_SET}\-]*", "")
    return bind(cut, tidy)


def invoice_number(text: Column, file_stem: Column, low: Column | None = None) -> Column:
    """Labelled number, else the first 'INV-123' in the text, else 'INV_<file stem>'."""
    labelled = clean_invoice_number(value_after_keywords(text, K.INVOICE_NUMBER_KEYWORDS, low))
    bare = rf"(?iu)INV(?<!{K.WORD}INV)[\-{K.SPACE_SET}_]*{K.DIGIT}+(?!{K.WORD})"
    return _or_else(
        labelled,
        bind(
            F.regexp_extract(text, bare, 0),
            lambda hit: F.when(hit != "", clean_invoice_number(hit)),
        ),
        F.concat(F.lit("INV_"), file_stem),
    )


# --- table lines -----------------------------------------------------------------------

def is_header_line(line: Column) -> Column:
    return bind(F.lower(line), lambda low: contains_any(low, K.HEADER_WORDS))


def _numbers_peeled(folded: Column) -> Column:
    """[description, number, ...]: the numeric words at the end of a line and the rest.

    The numeric tail is looked for on the reversed line, where it is a prefix that ends
    before a blank, so the search stays linear.
    """

    def parts(line: Column, tail: Column) -> Column:
        head = F.rtrim(line.substr(F.lit(1), F.length(line) - F.length(tail)))
        return F.concat(F.array(head), F.filter(F.split(tail, " ", -1), lambda t: t != ""))

    tail = rf"\A[{K.DIGIT}.,\-() ]*(?![^ ])"
    return bind(
        folded,
        lambda line: bind(
            F.reverse(F.regexp_extract(F.reverse(line), tail, 0)), lambda t: parts(line, t)
        ),
    )


def _cells(row: Column, gaps: str, folded: Column) -> Column:
    return bind(
        F.split(row, gaps, -1),
        lambda tokens: F.when(
            F.size(tokens) >= 3, F.filter(F.transform(tokens, strip), lambda t: t != "")
        ).otherwise(_numbers_peeled(folded)),
    )


def row_cells(row: Column) -> Column:
    """array<string>: the cells of one table line.

    Wide gaps, tabs and ' | ' split a line if that gives three cells or more; else the
    numbers at its end are peeled off and the rest is the description.
    """
    gaps = rf"{K.SPACE}{{2,}}|\t|{K.SPACE}\|{K.SPACE}"
    return bind(strip(row), lambda r: _cells(r, gaps, fold_spaces(r)))


def folded_row_cells(line: Column) -> Column:
    """The same for a line with its white space folded, where only ' | ' can split."""
    return _cells(F.replace(line, F.lit(K.CELL_SEPARATOR), F.lit(_MARK)), _MARK, line)


_MARK = "\f"  # ends a line, so it is never in one
_HEADER = "(?:" + "|".join(map(re.escape, _needed(K.HEADER_WORDS))) + ")"


def _cut_at_footers(text: Column) -> Column:
    """The text's tidied lines, cut at footer lines. A line with a header word is never a footer.

    No tidied line holds a form feed, so that one can stand for the footer: ``split`` compiles a pattern
    for every text, unless it is a single character, while a replacement keeps its pattern.
    """
    starts = "|".join(re.escape(s) for s in K.FOOTER_STARTS)
    footer = rf"(?dim)^(?:{starts})(?!{K.WORD})(?<!{_HEADER})(?![^\n]*{_HEADER})[^\n]*$"
    return F.split(F.regexp_replace(_lines_joined(text), footer, _MARK), _MARK, -1)


def table_rows(text: Column, opened: Column | None = None) -> Column:
    """array<string>: the line items of one document, in order.

    A header line opens the table and is dropped itself, a footer line closes it, and
    lines with a digit are rows while it is open. The lines come from one text cell, so
    the state is worked out inside that row, without a shuffle: the text is cut at its
    footer lines, a segment's table is what follows its first header line, and its rows
    are the lines there with a digit and without a header word. The place in the array is the row
    number. ``opened`` says whether a table is open where the text begins, for a text that is a part of
    a document; its first segment is then all table.
    """
    after_header = rf"(?is){_HEADER}[^\n]*\n(.*)"
    with_digit = rf"(?dm)^(?=[^\n]*{K.DIGIT})[^\n]+"
    began = F.lit(False) if opened is None else opened

    def rows_in(table: Column) -> Column:
        lines = F.regexp_extract_all(table, F.lit(with_digit), F.lit(0))
        # one look at the table instead of one for each line and word: most have no header word below their header
        return F.when(is_header_line(table), F.filter(lines, lambda line: ~is_header_line(line))).otherwise(lines)

    def rows_of_segment(segment: Column, i: Column) -> Column:
        behind = F.regexp_extract(segment, after_header, 1)
        return bind(behind if opened is None else F.when((i == 0) & began, segment).otherwise(behind), rows_in)

    rows = F.transform(_cut_at_footers(text), rows_of_segment)
    none = F.array().cast("array<string>")
    return F.when(is_header_line(text) | began, F.flatten(rows)).otherwise(none)


def table_state(text: Column) -> Column:
    """What a part of a document does to the table: true leaves it open, false closed, null as it was.

    These are functions of the state before, and one after the other they make such a function again:
    the last of them that is not null.
    """
    segments = _cut_at_footers(text)
    state = bind(
        segments,
        lambda s: F.when(is_header_line(F.element_at(s, -1)), F.lit(True)).when(F.size(s) > 1, F.lit(False)),
    )
    return F.when(contains_any(F.lower(text), (*K.HEADER_WORDS, *K.FOOTER_STARTS)), state)
