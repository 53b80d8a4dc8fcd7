"""The three stages - extract, clean, postprocess - and the run that chains them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions.text import is_blank, table_rows
from billfold.operators import layout, tables
from billfold.operators.cleaning import CLEANED_SCHEMA, clean_rows, split_summary
from billfold.operators.fields import invoice_records, row_counts, stamp_rows, with_fields
from billfold.operators.merge import evolve_schema, skip_seen
from billfold.operators.reconcile import reconcile, reconcile_cleaned
from billfold.sources.files import failure_reason, is_unread, split_failures
from billfold.sources.commits import Conflict
from billfold.sources.store import BillingStore, Transaction, dump_text, export_json, export_tables

_ROW = ("invoice_number", "file_name", "row_number", "raw_text", "cols", "file_path")


class Extracted(NamedTuple):
    invoices: DataFrame
    rows: DataFrame
    failures: DataFrame
    texts: DataFrame  # file_stem and text of what was processed


class Postprocessed(NamedTuple):
    items: DataFrame
    totals: DataFrame
    verification: DataFrame


@dataclass(frozen=True)
class PageInputs:
    """What the per-file readers found in PDF and image files, as tables.

    page_text(doc_id, page_no, text), page_tables(doc_id, page_no, table_no, rows),
    ocr_pages(doc_id, page_no, text), words (word boxes), cells (cell boxes, with an
    optional ``confs array<double>``, the confidences of the words read in the cell).
    """

    page_text: DataFrame
    page_tables: DataFrame
    ocr_pages: DataFrame
    words: DataFrame
    cells: DataFrame


def _as_is(df: DataFrame) -> DataFrame:
    return df


def parse_texts(docs: DataFrame) -> DataFrame:
    """Text documents with fields, rows as an array and row count, without the text. Narrow."""
    return (
        with_fields(docs)
        .withColumn("rows", table_rows(F.col("text")))
        .withColumn("table_data_count", F.size("rows").cast("bigint"))
        .withColumn("avg_confidence", F.lit(None).cast("double"))
        .drop("text")
    )


def rows_of(parsed: DataFrame) -> DataFrame:
    """The raw rows of parsed text documents."""
    return tables.numbered_rows(parsed, "rows", "invoice_number", "file_name", "file_path").select(*_ROW)


_PAGE = ["doc_id", "page_num"]


def _reads_layout(words: DataFrame) -> bool:
    return set(layout.LAYOUT_KEYS) <= set(words.columns)


def page_rows(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows found on each page image: grid rows of the cells, text lines of the words.

    ``words`` are those of pages without a large enough cell, whose rows are lines; ``page_evidence``
    tells these pages. Both are read once. Out: doc_id, page_num, row_number, raw_text, cols (null for lines).
    """
    columns = (*_PAGE, "row_number", "raw_text", "cols")
    grid = layout.number_lines_by_position(layout.rows_from_cells(layout.keep_cells(cells)))
    if _reads_layout(words):
        lines = layout.number_lines(layout.lines_from_words(words))
    else:
        lines = layout.number_lines_by_position(layout.lines_from_centres(words))
    lines = lines.withColumn("cols", F.lit(None).cast("array<string>"))
    return grid.select(*columns).unionByName(lines.select(*columns))


def page_evidence(words: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, page_num, gives_rows, has_cells, page_confidence, word_confidence of every page, from one pass over both.

    Known before any line is put together: a page gives rows if it has a large enough cell or a
    word that is not blank. Its confidence is that of its cells, of its words where it has
    none; ``word_confidence`` is the mean over all words, missing values as they are.
    """
    confidence = F.col("conf").try_cast("double") if "conf" in words.columns else F.lit(K.DEFAULT_CONFIDENCE)
    known = F.when(~F.isnan(confidence), confidence)
    gives = ~is_blank(F.col("text"))
    if _reads_layout(words):
        gives = reduce(and_, (F.col(c).isNotNull() for c in layout.LAYOUT_KEYS), gives)
    of_words = words.select(
        *_PAGE, gives.alias("gives"), F.lit(False).alias("is_cell"), known.alias("conf"),
        F.lit(None).cast("double").alias("cell_sum"), F.lit(None).cast("bigint").alias("cell_n"),
    )
    confs = F.col("confs") if "confs" in cells.columns else F.array().cast("array<double>")
    read = F.filter(F.transform(confs, lambda c: c.try_cast("double")), lambda c: c.isNotNull() & ~F.isnan(c))
    of_cells = layout.keep_cells(cells).select(
        *_PAGE, F.lit(True).alias("gives"), F.lit(True).alias("is_cell"), F.lit(None).cast("double").alias("conf"),
        F.aggregate(read, F.lit(0.0), lambda total, c: total + c).alias("cell_sum"),
        F.greatest(F.size(read), F.lit(0)).cast("bigint").alias("cell_n"),
    )
    conf = F.col("conf")
    pages = of_words.unionByName(of_cells).groupBy(*_PAGE).agg(
        F.max("gives").alias("gives_rows"),
        F.max("is_cell").alias("has_cells"),
        F.avg(F.when(conf != K.NO_CONFIDENCE, conf) if "conf" in words.columns else conf).alias("line_confidence"),
        F.avg(conf).alias("word_confidence"),
        F.sum("cell_sum").alias("cell_sum"),
        F.sum("cell_n").alias("cell_n"),
    )
    in_cells = F.when(F.col("cell_n") > 0, F.col("cell_sum") / F.col("cell_n"))
    return pages.select(
        *_PAGE, "gives_rows", "has_cells", F.when(F.col("has_cells"), in_cells).otherwise(F.col("line_confidence")).alias("page_confidence"),
        "word_confidence",
    )


TABLES, PAGE, TEXT = 1, 2, 3  # where the rows of a PDF or image file come from, first come first


def row_sources(docs: DataFrame, pages: PageInputs) -> DataFrame:
    """``docs`` with ``source``, the page rows come from, whether it has cells, and the confidences, all from counts.

    PDF: rows of the text layer's tables; without any, the rows of the first page image
    that has some; without any, rows parsed from the whole text. Image: rows of its one
    page, else from the text. A document's confidence is the mean over the pages up to the one its rows come
    from; where tables give the rows, no page is looked at.
    """
    tabled = pages.page_tables.where(F.size(tables.table_body()) > 0).select("doc_id").distinct()
    first = F.min(F.when(F.col("gives_rows"), F.col("page_num"))).over(Window.partitionBy("doc_id"))
    reached = F.col("first").isNull() | (F.col("page_num") <= F.col("first"))
    evidence = (
        page_evidence(pages.words, pages.cells)
        .withColumn("first", first)
        .groupBy("doc_id")
        .agg(
            F.first("first").alias("page_num"),
            F.max(F.when(F.col("page_num") == F.col("first"), F.col("has_cells"))).alias("has_cells"),
            F.avg(F.when(reached, F.col("page_confidence"))).alias("read_confidence"),
            F.avg("word_confidence").alias("word_confidence"),
        )
    )
    by_table = F.col("tabled").isNotNull() & F.col("ext").isin(*K.PDF_EXTENSIONS)
    source = F.when(by_table, TABLES).when(F.col("page_num").isNotNull(), PAGE).otherwise(TEXT)
    read = F.when(F.col("source") != TABLES, F.col("read_confidence"))
    of_words = F.when(F.col("ext").isin(*K.IMAGE_EXTENSIONS), F.col("word_confidence"))
    return (
        docs.join(tabled.withColumn("tabled", F.lit(True)), "doc_id", "left")
        .join(evidence, "doc_id", "left")
        .withColumn("source", source)
        .withColumn("avg_confidence", F.coalesce(read, of_words))
        .drop("tabled", "read_confidence", "word_confidence")
    )


def _extract_pages(
    docs: DataFrame, pages: PageInputs, stage: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(documents with text, count and confidence; their rows) of PDF and image files.

    One staged frame has, for each document, where its rows come from, its text and its
    fields, and the rows parsed from the text where that is the source. Tables, words and cells are then
    cut down to the documents and pages that were chosen before anything is put together.
    """
    is_pdf = F.col("ext").isin(*K.PDF_EXTENSIONS)
    placed = row_sources(docs.drop("text"), pages)
    layer = tables.assemble_pages(pages.page_text)
    with_layer = placed.join(layer, "doc_id", "left").withColumn("text", F.when(is_pdf, F.col("text")))
    texts = tables.append_fallback_text(with_layer, pages.ocr_pages, F.col("source") == TABLES)
    parsed = F.when(F.col("source") == TEXT, table_rows(F.col("text")))
    read = stage(with_fields(texts).withColumn("text_rows", parsed))

    def of_tables(own: DataFrame) -> DataFrame:
        return tables.flatten_page_tables(pages.page_tables.join(own.select("doc_id"), "doc_id", "left_semi"))

    def of_pages(own: DataFrame) -> DataFrame:
        # hashed, as there is one row a page: the words and cells, many rows a page, need not be sorted to meet it
        plain, grid = (own.where(F.col("has_cells") == has).select(*_PAGE).hint("shuffle_hash") for has in (False, True))
        return page_rows(pages.words.join(plain, _PAGE, "left_semi"), pages.cells.join(grid, _PAGE, "left_semi"))

    def of_text(own: DataFrame) -> DataFrame:
        return tables.numbered_rows(own, "text_rows", "doc_id")

    columns = ("doc_id", "row_number", "raw_text", "cols")
    sources = [lambda own, build=build: build(own).select(*columns) for build in (of_tables, of_pages, of_text)]
    rows = stage(tables.choose_row_source(sources, read).drop("source"))
    measured = read.drop("text_rows", "page_num", "has_cells", "source").join(row_counts(read, rows), "doc_id", "left")
    return measured, rows


def extract(
    docs: DataFrame,
    pages: PageInputs | None = None,
    min_confidence: float | None = None,
    run_ts: str | None = None,
    stage: Callable[[DataFrame], DataFrame] = _as_is,
) -> Extracted:
    """Documents to invoice records, raw table rows and failures.

    Text documents take a narrow plan: fields, rows and count all come from one pass over
    the text, without a shuffle. ``stage`` may write an intermediate result and read it
    back, so that what uses it does not repeat it; ``BillingStore.stage`` does. PDF and
    image files need ``pages``; without it they fail for want of text.
    """
    unread = is_unread(docs)
    by_pages = F.lit(False)
    if pages is not None:
        by_pages = F.col("ext").isin(*K.PDF_EXTENSIONS, *K.IMAGE_EXTENSIONS) & ~unread
    reason = failure_reason(F.col("ext"), F.col("text"), unread)
    read = stage(parse_texts(docs.where(~by_pages).withColumn("error", reason)))
    failed = F.col("error").isNotNull()
    parsed = read.where(~failed)
    failures = read.where(failed).select(F.col("file_path").alias("file"), "error")
    invoices = invoice_records(parsed, min_confidence, run_ts)
    rows = rows_of(parsed)
    texts = docs.where(~by_pages & reason.isNull()).select("file_stem", "text")
    if pages is not None:
        measured, page_lines = _extract_pages(docs.where(by_pages), pages, stage)
        readable, unreadable = split_failures(measured)
        invoices = invoices.unionByName(invoice_records(readable, min_confidence, run_ts))
        rows = rows.unionByName(stamp_rows(page_lines, readable).select(*_ROW))
        failures = failures.unionByName(unreadable)
        texts = texts.unionByName(readable.select("file_stem", "text"))
    return Extracted(invoices, rows, failures, texts)


def clean(rows: DataFrame) -> DataFrame:
    """Raw rows to cleaned rows; a narrow filter and projection."""
    return clean_rows(rows)


def postprocess(cleaned: DataFrame) -> Postprocessed:
    """Items, totals and verification of any cleaned table.

    Columns of the cleaned table that are absent count as null. Without ``file_name`` and
    ``row_number`` summary rows are taken by amount, the smallest first.
    """
    cleaned = evolve_schema(cleaned, CLEANED_SCHEMA)
    items, totals = split_summary(cleaned)
    return Postprocessed(items, totals, reconcile_cleaned(cleaned))


@dataclass(frozen=True)
class RunOptions:
    skip_extract: bool = False
    skip_clean: bool = False
    skip_post: bool = False
    force: bool = False
    min_confidence: float | None = None
    run_ts: str | None = None
    batch: str | None = None
    export_path: str | None = None
    export_format: str = "parquet"
    json_path: str | None = None
    debug_path: str | None = None


def run_stages(
    store: BillingStore,
    docs: DataFrame | None = None,
    pages: PageInputs | None = None,
    options: RunOptions | None = None,
) -> dict[str, DataFrame]:
    """Runs the stages against a store and returns the tables they wrote.

    Every stage reads what the one before has written, so a lost executor costs one
    task, a failed stage stops the rest, and a skipped stage uses the stored table.
    Each stage is one commit: what a run that breaks has written is not seen. Cleaning and
    splitting take the batches that are newer than their results, and the one just ingested;
    reconciliation takes the invoices that these batches touch or have touched before.
    """
    o = options or RunOptions()
    out: dict[str, DataFrame] = {}
    added: set[str] = set()
    if not o.skip_extract:
        if docs is None:
            raise ValueError("extraction needs documents")
        o = replace(o, batch=o.batch or uuid.uuid4().hex)
        ingest(store, docs, pages, o)
        added.add(o.batch)
        out.update({n: store.read(n) for n in ("invoices", "rows", "failures")})
        if o.export_path:
            export_tables({n: out[n] for n in ("invoices", "rows")}, o.export_path, o.export_format)
    if not o.skip_clean:
        _clean_new(store, added)
        out["cleaned"] = store.read("cleaned")
    if not o.skip_post:
        _postprocess_new(store, added)
        out["items"], out["totals"] = store.read("items"), store.read("totals")
        out["verification"] = store.read("verification")
        if o.json_path:
            export_json(out["items"], out["totals"], out["verification"], o.json_path)
    return out


_ATTEMPTS = 5
_STAGED_DOCS = "staged_documents"


def _again(attempt: Callable[[], None]) -> None:
    """Runs it once more, on the version that is there by then, where another run has got in between."""
    for left in range(_ATTEMPTS - 1, -1, -1):
        try:
            return attempt()
        except Conflict:
            if not left:
                raise


def _pending(store: BillingStore, source: str, target: str, added: set[str]) -> set[str]:
    """Batches of the source that the target has not or has from before, or that this run has written."""
    there, done = store.versions_of_batches(source), store.versions_of_batches(target)
    return {b for b, version in there.items() if b in added or b not in done or done[b] < version}


def _clean_new(store: BillingStore, added: set[str]) -> None:
    def attempt() -> None:
        if new := _pending(store, "rows", "cleaned", added):
            with store.transaction() as changes:
                changes.write_batches("cleaned", clean_rows(changes.read_batches("rows", new), "batch"), new)
            added.update(new)

    _again(attempt)


def _postprocess_new(store: BillingStore, added: set[str]) -> None:
    """Items, totals and verification of the new batches, in one commit.

    The invoices whose verification is worked out anew are those the batches have rows of, and those they
    had rows of before: a batch that was run again may have lost some.
    """

    def attempt() -> None:
        new = _pending(store, "cleaned", "items", added)
        if not new:
            return
        with store.transaction() as changes:
            first = not changes.state.parts("verification")
            rows = changes.read_batches("cleaned", new)
            items, totals = split_summary(rows, "batch")
            changes.write_batches("items", items, new)
            changes.write_batches("totals", totals, new)
            buckets = store.verification_buckets(changes.state)
            changes.set(verification_buckets=buckets)
            if first and new >= store.batches("items") | store.batches("cleaned"):
                verified, touched = reconcile_cleaned(rows), {str(b) for b in range(buckets)}
            else:
                verified, touched = _verified_anew(store, changes, new, buckets, first)
            bucketed = verified.withColumn("batch", bucket_of(buckets)).hint("rebalance", "batch")
            changes.write_batches("verification", bucketed, touched)
        store.drop_staged()

    _again(attempt)


def bucket_of(buckets: int) -> Column:
    """The bucket of the verification that an invoice number lies in."""
    return F.pmod(F.xxhash64("invoice_number"), F.lit(buckets)).cast("string")


def _verified_anew(
    store: BillingStore, changes: Transaction, batches: set[str], buckets: int, everything: bool
) -> tuple[DataFrame, set[str]]:
    """The whole contents of those buckets of the verification that the batches touch, and the buckets.

    Only the touched buckets are read and written; the driver learns their numbers.
    """
    if everything:
        verified = reconcile(changes.read("items"), changes.read("totals"))
        return verified, {str(b) for b in range(buckets)}
    sides = [changes.read_batches(n, batches, before) for n in ("items", "totals") for before in (True, False)]
    numbers = reduce(DataFrame.unionByName, (s.select("invoice_number") for s in sides))
    touched = store.stage(numbers.where(F.col("invoice_number").isNotNull()).distinct().withColumn("bucket", bucket_of(buckets)))
    of = {r.bucket for r in touched.select("bucket").distinct().collect()}
    touched = touched.select("invoice_number")
    items, totals = (changes.read(n).join(touched, "invoice_number", "left_semi") for n in ("items", "totals"))
    others = changes.read_batches("verification", of).drop("batch").join(touched, "invoice_number", "left_anti")
    return others.unionByName(reconcile(items, totals)), of


def ingest(
    store: BillingStore, docs: DataFrame, pages: PageInputs | None = None, options: RunOptions | None = None
) -> None:
    """Adds one batch of documents to the stored invoices, rows and failures, in one commit.

    The documents are staged first, with hash and text but without their bytes: files are
    read once (once more if another run gets in between), and the check against the stored hashes reads a
    column of the staged table. The staged texts are deleted when all that is taken from them is written.
    """
    o = options or RunOptions()
    batch = o.batch or uuid.uuid4().hex

    def attempt() -> None:
        with store.transaction() as changes:
            staged = store.stage(docs, _STAGED_DOCS)
            known = changes.read("invoices", without_batch=batch)
            fresh = skip_seen(staged, known, o.force or known.isEmpty(), store.stage)
            found = extract(fresh, pages, o.min_confidence, o.run_ts, store.stage)
            if o.debug_path:
                dump_text(found.texts, o.debug_path, batch)
            store.drop_staged(_STAGED_DOCS)
            rows = found.rows.withColumn("raw_text", tables.raw_text_or_cells(F.col("raw_text"), F.col("cols")))
            changes.add_ignore("rows", rows, batch)
            changes.add_ignore("failures", found.failures, batch)
            changes.add_ignore("invoices", found.invoices, batch)

    _again(attempt)
    store.drop_staged()
