"""Raw rows to cleaned rows, cleaned rows to items and summary rows. All narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billfold.functions import numbers as N
from billfold.functions.text import is_blank, strip

CLEANED_SCHEMA = (
    "invoice_number string, description string, qty double, rate double, amount double, "
    "file_name string, row_number int"
)
ORDER = ("file_name", "row_number")


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~is_blank(F.col("raw_text")))


def drop_summary_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~N.is_summary_row(F.col("raw_text")))


def description_of(raw: Column) -> Column:
    """The first line of the stripped raw text."""
    return F.substring_index(strip(raw), "\n", 1)


def clean_rows(rows: DataFrame, *carried: str) -> DataFrame:
    """invoice_number, description, qty, rate, amount, the order columns and the carried ones."""
    kept = drop_summary_rows(drop_blank_rows(rows))
    return kept.select(
        "invoice_number",
        description_of(F.col("raw_text")).alias("description"),
        N.qty_rate_amount(F.col("raw_text")).alias("__v"),
        *ORDER,
        *carried,
    ).select("invoice_number", "description", "__v.qty", "__v.rate", "__v.amount", *ORDER, *carried)


def _number(column: str, df: DataFrame, text_form, number_form) -> Column:
    """A numeric column stays numeric; a text column is parsed."""
    if df.schema[column].dataType.typeName() == "string":
        return text_form(F.col(column))
    return number_form(F.col(column).cast("double"))


def _not_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def with_amounts(cleaned: DataFrame, *carried: str) -> DataFrame:
    """Adds ``kind`` (item or the type of summary row) and the normalised numbers."""
    description = F.col("description")
    amount = _number("amount", cleaned, N.normalize_amount, _not_nan)
    return cleaned.select(
        "invoice_number",
        "description",
        F.when(N.is_summary_description(description), N.summary_type(description))
        .otherwise("item")
        .alias("kind"),
        _number("qty", cleaned, N.normalize_qty_text, N.normalize_qty).alias("qty"),
        _number("rate", cleaned, N.normalize_amount, _not_nan).alias("rate"),
        F.coalesce(amount, N.last_number(description)).alias("amount"),
        *ORDER,
        *carried,
    )


def _items(valued: DataFrame) -> DataFrame:
    return valued.where(F.col("kind") == "item").drop("kind")


def _totals(valued: DataFrame, *carried: str) -> DataFrame:
    return valued.where(F.col("kind") != "item").select(
        "invoice_number",
        F.col("kind").alias("type"),
        F.col("description").alias("raw"),
        F.col("amount").alias("parsed_amount"),
        *ORDER,
        *carried,
    )


def split_summary(cleaned: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(items, totals) of a cleaned table."""
    summary = N.is_summary_description(F.col("description"))
    items, totals = (with_amounts(cleaned.where(c), *carried) for c in (~summary, summary))
    return _items(items), _totals(totals, *carried)
