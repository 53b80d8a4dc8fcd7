"""Page texts, page tables and the choice of where a document's rows come from."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions.text import folded_row_cells, is_blank, row_cells, strip, table_rows, table_state
from billfold.operators.grouping import explode_rows, running_sum


def document_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Line items of each document text: the document's columns without the text,
    row_number, raw_text, cols. A narrow plan: no shuffle, no window."""
    carried = [c for c in docs.columns if c != text]
    return numbered_rows(docs, table_rows(F.col(text)), *carried)


def split_rows(splits: DataFrame) -> DataFrame:
    """Line items of documents that come in parts: doc_id, row_number, raw_text, cols.

    ``splits(doc_id, split_no, text)``, each a run of whole lines, in the order of ``split_no``. What each part
    does to the table is worked out on its own; the state it begins in is the last that parts before it have
    left, a window over one small row per part. A part's text meets only that state, so a document
    is spread over as many tasks as it has parts, and its size has no limit.
    """
    key = ["doc_id", "split_no"]
    before = Window.partitionBy("doc_id").orderBy("split_no").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select(*key, table_state(F.col("text")).alias("__state"))
    opened = F.coalesce(F.last("__state", ignorenulls=True).over(before), F.lit(False))
    begun = splits.join(states.select(*key, opened.alias("__opened")), key)
    parsed = begun.select(*key, table_rows(F.col("text"), F.col("__opened")).alias("rows"))
    numbered = running_sum(parsed, ["doc_id"], ["split_no"], F.size("rows"), block=["split_no"], out="__upto")
    placed = numbered.withColumn("__first", F.col("__upto") - F.size("rows"))
    return explode_rows(placed, "rows", "doc_id", "__first").select(
        "doc_id",
        (F.col("__first") + F.col("pos") + 1).cast("int").alias("row_number"),
        F.col("item").alias("raw_text"),
        folded_row_cells(F.col("item")).alias("cols"),
    )


def numbered_rows(docs: DataFrame, rows: Column | str, *carried: str) -> DataFrame:
    """An array of table lines as rows, with number and cells; unused cells cost nothing."""
    return explode_rows(docs, rows, *carried).select(
        *carried,
        (F.col("pos") + 1).alias("row_number"),
        F.col("item").alias("raw_text"),
        folded_row_cells(F.col("item")).alias("cols"),
    )


def keep_digit_lines(lines: DataFrame, column: str = "raw_text") -> DataFrame:
    return lines.where(F.col(column).rlike(K.DIGIT))


def _pages_joined(skip_blank: bool) -> Column:
    page = F.struct(F.col("page_no"), F.col("text"))
    if skip_blank:
        page = F.when(~is_blank(F.col("text")), page)
    pages = F.sort_array(F.collect_list(page))
    return F.array_join(
        F.transform(pages, lambda p: F.concat(F.lit("\n"), F.coalesce(p["text"], F.lit("")))), ""
    )


def assemble_pages(page_text: DataFrame) -> DataFrame:
    """doc_id, text: the non-blank pages in order, each after a line end."""
    return page_text.groupBy("doc_id").agg(_pages_joined(skip_blank=True).alias("text"))


def append_fallback_text(docs: DataFrame, ocr_pages: DataFrame, has_rows: DataFrame | Column) -> DataFrame:
    """Appends the OCR text of every page where the text is blank or no row was found.

    ``has_rows`` holds the doc_ids with table rows, or is a column of ``docs`` that says so; a document with text
    but without rows therefore holds its text twice.
    """
    ocr = ocr_pages.groupBy("doc_id").agg(_pages_joined(skip_blank=False).alias("__ocr"))
    if isinstance(has_rows, DataFrame):
        found = has_rows.select("doc_id").distinct().withColumn("__rows", F.lit(True))
        docs, has_rows = docs.join(found, "doc_id", "left"), F.col("__rows").isNotNull()
    text = F.coalesce(F.col("text"), F.lit(""))
    needs_ocr = is_blank(F.col("text")) | ~has_rows
    return (
        docs.join(ocr, "doc_id", "left")
        .withColumn("text", F.when(needs_ocr, F.concat(text, F.coalesce("__ocr", F.lit("")))).otherwise(text))
        .drop("__ocr", "__rows")
    )


def table_body() -> Column:
    """The rows of a page table below its header: all of them where the first row has no cell."""
    return F.when(
        F.size(F.get("rows", F.lit(0))) > 0, F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))
    ).otherwise(F.col("rows"))


def flatten_page_tables(tables: DataFrame) -> DataFrame:
    """Rows of the page tables: doc_id, row_number, raw_text, cols.

    The first row of a table is its header and is dropped if it has any cell. Null cells
    are left out of ``raw_text`` and are '' in ``cols``. Row numbers run over all tables
    of the document, which come from one file; they are summed per table before the rows are exploded, and the tables
    are read and shuffled once. Tables without a document or page are left out; those without a page count as the first.
    """
    bodies = tables.select("doc_id", "page_no", "table_no", table_body().alias("body")).dropna(subset=["doc_id"])
    upto = Window.partitionBy("doc_id").orderBy("page_no", "table_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = bodies.withColumn("__upto", F.sum(F.size("body")).over(upto)).dropna(subset=["page_no"])
    cells = F.col("item")
    return (
        explode_rows(numbered.withColumn("__first", F.col("__upto") - F.size("body")), "body", "doc_id", "__first")
        .select(
            "doc_id",
            (F.col("__first") + F.col("pos") + 1).cast("int").alias("row_number"),
            F.array_join(F.transform(cells, strip), K.CELL_SEPARATOR).alias("raw_text"),
            F.transform(cells, lambda c: F.coalesce(strip(c), F.lit(""))).alias("cols"),
        )
    )


def first_page_with_rows(page_rows: DataFrame) -> DataFrame:
    """Rows of the first page of each document that has any (doc_id, page_num, ...)."""
    first = page_rows.groupBy("doc_id").agg(F.min("page_num").alias("page_num"))
    return page_rows.join(first, ["doc_id", "page_num"], "left_semi").select(*page_rows.columns)


def choose_row_source(
    sources: Sequence[DataFrame | Callable[[DataFrame], DataFrame]], chosen: DataFrame | None = None
) -> DataFrame:
    """Rows of the first source, in list order, that has any row for the document.

    Every source has the same columns with doc_id among them; out has ``source``, the
    1-based place of the chosen one. Where it is known beforehand which source a document's rows come from,
    ``chosen`` says so (doc_id, source, ...), and a source may be a function: it gets the rows of ``chosen`` that
    are its own and builds the rows of these documents only.
    """
    if chosen is None:
        named = [s.select("doc_id", F.lit(i).alias("source")) for i, s in enumerate(sources, 1)]
        chosen = reduce(DataFrame.unionByName, named).groupBy("doc_id").agg(F.min("source").alias("source"))
    parts = []
    for i, source in enumerate(sources, 1):
        own = chosen.where(F.col("source") == i)
        rows = source(own) if callable(source) else source.join(own.select("doc_id"), "doc_id", "left_semi")
        parts.append(rows.withColumn("source", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def append_row_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources' rows, the second numbered on after the first (images)."""
    counts = first.groupBy("doc_id").agg(F.max("row_number").alias("__last"))
    moved = (
        second.join(counts, "doc_id", "left")
        .withColumn("row_number", F.col("row_number") + F.coalesce("__last", F.lit(0)))
        .drop("__last")
    )
    return first.unionByName(moved)


def raw_text_or_cells(raw_text: Column, cols: Column) -> Column:
    """The raw text, or the non-empty cells joined in the order of their column names.

    The names sort as text: col_1, col_10, col_11, col_2, ...
    """
    named = F.transform(cols, lambda v, i: F.struct(F.concat(F.lit("col_"), (i + 1).cast("string")), v.alias("v")))
    joined = F.array_join(
        F.transform(F.array_sort(F.filter(named, lambda x: x["v"] != "")), lambda x: x["v"]), K.CELL_SEPARATOR
    )
    return F.when(F.coalesce(raw_text, F.lit("")) != "", raw_text).otherwise(
        F.coalesce(joined, raw_text, F.lit(""))
    )


def parse_rows(rows: DataFrame, column: str = "raw_text") -> DataFrame:
    """Adds ``cols``, the cells of each raw line."""
    return rows.withColumn("cols", row_cells(F.col(column)))

