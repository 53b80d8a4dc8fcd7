"""Column functions on quantities, rates and amounts written as text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions.text import bind, contains_any, strip

_CURRENCY = "€$£"
_DIGITS = "".join(chr(c) for c in range(0x80, sys.maxunicode) if unicodedata.category(chr(c)) == "Nd")
_PLAIN_DIGITS = "".join(str(unicodedata.digit(d)) for d in _DIGITS)
_NUMBER = rf"{K.DIGIT}+(?:\.{K.DIGIT}+)?"
_DATE = rf"{K.DIGIT}{{1,2}}\.{K.DIGIT}{{1,2}}\.{K.DIGIT}{{2,4}}"


def plain_digits(text: Column) -> Column:
    """The decimal digits of every script as 0-9; a text in ASCII is not looked at any further."""
    return F.when(F.octet_length(text) > F.length(text), F.translate(text, _DIGITS, _PLAIN_DIGITS)).otherwise(text)


def looks_like_date(cell: Column) -> Column:
    """The whole cell is a date such as 27.09.2019."""
    return strip(cell).rlike(rf"\A{_DATE}\z")


def qty_rate_amount(raw: Column) -> Column:
    """struct<qty, rate, amount> of double read from one raw table row.

    Euro signs and all commas go first. A cell that is a date voids the row; then a
    'Qty a | b | c' group, then exactly three plain-number cells, then a number at the
    very end (an amount). The last one is read on the reversed text, where it is a
    prefix, so long digit runs stay linear.
    """
    cell_start, cell_end = rf"(?<![^|]){K.SPACE}*", rf"{K.SPACE}*(?![^|])"
    group = rf"([{K.DIGIT}.]+)"
    between = rf"{K.SPACE}*\|{K.SPACE}*"
    qty = rf"(?i)Qty\.?{K.SPACE}*{group}{between}{group}{between}{group}"

    def triple(a: Column, b: Column, c: Column) -> Column:
        return F.struct(
            a.try_cast("double").alias("qty"),
            b.try_cast("double").alias("rate"),
            c.try_cast("double").alias("amount"),
        )

    null = F.lit(None).cast("string")

    def amount_at_end(text: Column) -> Column:
        last = F.reverse(F.regexp_extract(F.reverse(text), rf"\A{_NUMBER}", 0))
        return triple(null, null, last)

    def from_cells(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"{cell_start}({_NUMBER}){cell_end}"), F.lit(1))
        return bind(
            found,
            lambda cells: F.when(
                F.size(cells) == 3, triple(*(F.get(cells, F.lit(i)) for i in (0, 1, 2)))
            ).otherwise(amount_at_end(text)),
        )

    def values(text: Column) -> Column:
        # any date at all is looked for first, a cell that is one only then
        is_date = text.rlike(_DATE) & text.rlike(cell_start + _DATE + cell_end)
        return (
            F.when(is_date, triple(null, null, null))
            .when(~text.contains("|"), amount_at_end(text))
            .when(F.lower(text).contains("qty") & text.rlike(qty), triple(*(F.regexp_extract(text, qty, g) for g in (1, 2, 3))))
            .otherwise(from_cells(text))
        )

    # most rows have no sign to drop: a byte search is cheaper than a look at every character
    signs = raw.contains(",") | raw.contains("€")
    return bind(plain_digits(strip(F.when(signs, F.translate(raw, "€,", "")).otherwise(raw))), values)


def _last_number(text: Column) -> Column:
    found = F.regexp_extract_all(plain_digits(text), F.lit(f"(-?{_NUMBER})"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def last_number(text: Column) -> Column:
    """The last number in a text, currency signs dropped, comma read as a point."""
    return _last_number(F.translate(text, "," + _CURRENCY, "."))


def normalize_amount(text: Column) -> Column:
    """A rate or amount written in any of the usual separator styles.

    With both signs present the later one is the decimal mark; a comma alone is a
    thousands mark. Numbers inside other text count, the last one wins.
    """
    plain = F.translate(text, _CURRENCY, "")
    comma_is_decimal = plain.contains(".") & plain.rlike(r",[^.]*\z")
    return _last_number(
        F.when(comma_is_decimal, F.translate(plain, ",.", ".")).otherwise(F.translate(plain, ",", ""))
    )


def normalize_qty(qty: Column) -> Column:
    """A numeric quantity, cut to a whole number toward zero."""
    whole_range = F.abs(qty) < F.lit(2.0**53)  # larger doubles are whole already
    return F.when(F.isnan(qty), None).when(whole_range, qty.cast("bigint").cast("double")).otherwise(qty)


def normalize_qty_text(qty: Column) -> Column:
    """A quantity kept as text: '2,5' and '2.5' stay fractional, unlike the numeric form."""
    plain = plain_digits(strip(qty))
    dotted = F.translate(plain, ",", ".")
    signed = F.regexp_replace(plain, r"(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(
        F.when(dotted.rlike(r"\A[0-9]+(\.[0-9]+)?\z"), dotted.try_cast("double")),
        F.when(
            signed.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"),
            signed.try_cast("double"),
        ),
    )


def is_summary_row(raw: Column) -> Column:
    """Raw rows that speak of totals, tax or dues; they are dropped when cleaning."""
    return contains_any(F.lower(raw), K.SUMMARY_ROW_WORDS)


def is_summary_description(description: Column) -> Column:
    return F.coalesce(contains_any(F.lower(description), K.SUMMARY_DESCRIPTION_WORDS), F.lit(False))


def summary_type(description: Column) -> Column:
    """subtotal, tax, total or other."""
    low = F.lower(description)
    return (
        F.when(low.contains("subtotal"), "subtotal")
        .when(contains_any(low, K.TAX_WORDS), "tax")
        .when(contains_any(low, K.TOTAL_WORDS), "total")
        .otherwise("other")
    )


def amount_or_description(amount: Column, description: Column) -> Column:
    """The parsed amount, else the last number of the description. NaN counts as missing."""
    return F.coalesce(F.when(~F.isnan(amount), amount), last_number(description))


def is_low_confidence(average: Column, minimum: float | None) -> Column:
    if minimum is None:
        return F.lit(False)
    return F.coalesce(average < F.lit(float(minimum)), F.lit(False))
