"""Field extraction: one record per document, in one narrow pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions.numbers import is_low_confidence
from billfold.functions.text import address, invoice_number, value_after_keywords

INVOICE_SCHEMA = (
    "file_name string, file_path string, extraction_date string, invoice_from string, "
    "invoice_to string, address string, invoice_number string, salesperson string, "
    "table_data_count bigint, raw_text_preview string, file_hash string, "
    "avg_confidence double, low_confidence_flag boolean"
)
ROW_SCHEMA = "invoice_number string, file_name string, row_number int, raw_text string, cols array<string>"


def party_columns(text: Column, low: Column) -> list[Column]:
    return [
        value_after_keywords(text, K.SELLER_KEYWORDS, low).alias("invoice_from"),
        value_after_keywords(text, K.BUYER_KEYWORDS, low).alias("invoice_to"),
        value_after_keywords(text, K.SALESPERSON_KEYWORDS, low).alias("salesperson"),
    ]


def with_fields(docs: DataFrame) -> DataFrame:
    """Adds invoice_from, invoice_to, address, invoice_number, salesperson and the preview.

    Needs ``text`` and ``file_stem``. The lower-case text is made once for all fields.
    """
    text, low = F.col("text"), F.col("__low")
    return docs.withColumn("__low", F.lower("text")).select(
        *docs.columns,
        *party_columns(text, low),
        address(text, low).alias("address"),
        invoice_number(text, F.col("file_stem"), low).alias("invoice_number"),
        F.substring(text, 1, K.PREVIEW_LENGTH).alias("raw_text_preview"),
    )


def stamp_rows(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Gives rows their document's invoice number, file name and file path."""
    stamps = ("invoice_number", "file_name", "file_path")
    return rows.drop(*stamps).join(fields.select("doc_id", *stamps), "doc_id", "inner")


def row_counts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, table_data_count; 0 for documents without rows."""
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("table_data_count"))
    return (
        docs.select("doc_id")
        .join(counted, "doc_id", "left")
        .withColumn("table_data_count", F.coalesce("table_data_count", F.lit(0)).cast("bigint"))
    )


def invoice_records(docs: DataFrame, min_confidence: float | None, run_ts: str | None) -> DataFrame:
    """The invoice table's rows from documents with fields, count and confidence.

    ``run_ts`` fixes the extraction time so that a run can be repeated; without it the
    time of the query is used.
    """
    stamped = (
        F.lit(run_ts) if run_ts is not None else F.date_format(F.current_timestamp(), K.TIMESTAMP_FORMAT)
    )
    return docs.select(
        "file_name",
        "file_path",
        stamped.alias("extraction_date"),
        "invoice_from",
        "invoice_to",
        "address",
        "invoice_number",
        "salesperson",
        F.col("table_data_count").cast("bigint").alias("table_data_count"),
        "raw_text_preview",
        "file_hash",
        F.col("avg_confidence").cast("double").alias("avg_confidence"),
        is_low_confidence(F.col("avg_confidence"), min_confidence).alias("low_confidence_flag"),
    )
