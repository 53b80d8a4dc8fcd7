"""One query per operator, over the given tables or data derived from them.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame. Nested results are
flattened to text or counts, so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billfold.functions import constants as K
from billfold.functions import numbers as N
from billfold.functions import text as T
from billfold.operators import cleaning, fields, grouping, layout, merge, reconcile, tables
from billfold.plans import stages
from billfold.sources import files
from billfold.sources.store import BillingStore, export_tables, export_texts, read_texts, scratch_folder
from billfold.streaming.ingest import ingest_stream
from billfold.workloads import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents(spark, sf_dir)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grouping.explode_rows(documents(spark, sf_dir), T.text_lines(F.col("text")), "doc_id")
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("item").alias("line"))


def joined(col: Column | str) -> Column:
    return F.array_join(col, "~")


def rounded(name: str, places: int = 4) -> Column:
    return F.round(F.col(name), places).alias(name)


def verification(df: DataFrame) -> DataFrame:
    money = ("items_sum", "parsed_subtotal", "parsed_tax", "parsed_total", "difference_items_vs_subtotal")
    return df.select("invoice_number", *(rounded(m) for m in money), "mismatch_flag")


# --- sources ---------------------------------------------------------------------------

@query
def s2_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", files.content_hash(F.col("text")).alias("file_hash")
    )


@query
def s3_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("doc_id") % 2 == 1
    crlf = F.regexp_replace("text", "\n", "\r\n")
    content = F.when(odd, F.encode(crlf, "ISO-8859-1")).otherwise(F.encode(crlf, "UTF-8"))
    return documents(spark, sf_dir).select("doc_id", files.decode_text(content).alias("text"))


def _troubled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.document_files(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_no") % 5 == 0, ".docx").otherwise(".txt").alias("ext"),
        F.when(F.col("doc_no") % 7 == 0, " \n ").otherwise(F.col("text")).alias("text"),
        "file_path",
    )


@query
def s4_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_failures(_troubled_files(spark, sf_dir))[1]


@query
def s4_processable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_failures(_troubled_files(spark, sf_dir))[0].select("doc_id", "text")


@query
def s5_assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.assemble_pages(X.page_texts(spark, sf_dir))


@query
def s6_flatten_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.flatten_page_tables(X.page_tables(spark, sf_dir))
    return rows.select("doc_id", "row_number", "raw_text", joined("cols").alias("cells"))


def _row_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    items = X.priced_items(spark, sf_dir).withColumn("m", F.col("l_orderkey") % 4)

    def rows(keep: Column, tag: str, column: str) -> DataFrame:
        return items.where(keep).select(
            F.col("l_orderkey").alias("doc_id"),
            F.concat(F.lit(tag), F.col(column).cast("string")).alias("raw_text"),
        )

    m = F.col("m")
    return [rows(m == 0, "T", "l_partkey"), rows(m <= 1, "O", "l_suppkey"), rows(m <= 3, "X", "qty")]


@query
def s7_choose_row_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.choose_row_source(_row_sources(spark, sf_dir)).select("doc_id", "raw_text", "source")


@query
def s7_first_page_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.priced_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), "amount_text"
    )
    return tables.first_page_with_rows(rows)


def _documents_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").cast("string"))


@query
def s8_append_fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = documents(spark, sf_dir).select(F.col("doc_id").cast("string"))
    docs = ids.join(tables.assemble_pages(X.page_texts(spark, sf_dir)), "doc_id", "left")
    return tables.append_fallback_text(docs, X.ocr_pages(spark, sf_dir), _documents_with_rows(spark, sf_dir))


@query
def s9_append_row_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).select(
        "doc_id", F.col("line_no").alias("row_number"), F.col("line").alias("raw_text")
    )
    return tables.append_row_sources(tables.keep_digit_lines(lines), lines)


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = X.document_files(spark, sf_dir).where(F.col("doc_no") % 3 == 0)
    first = grouping.keep_first(stored, ["file_hash"], ["doc_no"])
    return first.select("file_name", "file_hash", F.lit(0).alias("table_data_count"))


@query
def s10_insert_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = X.document_files(spark, sf_dir).withColumn("table_data_count", F.lit(1))
    return merge.merge_ignore(_stored_files(spark, sf_dir), incoming, ["file_hash"], ["doc_no"])


@query
def s11_insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.document_rows(X.invoice_texts(spark, sf_dir).select("file_name", "file_stem", "text"))
    keyed = BillingStore(spark, scratch_folder(spark)).stage(
        rows.select(
            F.lit("A").alias("invoice_number"), "file_name", "row_number", "raw_text",
            F.substring("file_stem", 7, 20).cast("bigint").alias("o"),
        )
    )
    stored = keyed.where(F.col("o") % 3 == 0).select("invoice_number", "file_name", "row_number", F.lit("old").alias("raw_text"))
    again = keyed.withColumn("raw_text", F.concat(F.lit("zz "), "raw_text"))
    return merge.merge_ignore(
        stored, keyed.unionByName(again), ["invoice_number", "file_name", "row_number"], ["raw_text"]
    )


@query
def s11_raw_text_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = F.split("line", " ", -1)
    raw = F.when(F.col("line_no") % 2 == 0, F.col("line")).otherwise("")
    return document_lines(spark, sf_dir).select(
        "doc_id", "line_no", tables.raw_text_or_cells(raw, cols).alias("raw_text")
    )


@query
def s12_evolve_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("file_name"), F.col("s_suppkey").cast("string").alias("file_hash")
    )
    return merge.evolve_schema(old, fields.INVOICE_SCHEMA)


@query
def s13_skip_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = merge.skip_seen(X.document_files(spark, sf_dir), _stored_files(spark, sf_dir))
    return new.select("doc_no", "file_name", "file_hash")


@query
def s14_stored_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into a store, the second with files it knows; read back."""
    store = BillingStore(spark, scratch_folder(spark))
    docs = X.document_files(spark, sf_dir)
    stages.ingest(store, docs.where(F.col("doc_no") % 3 == 0).drop("doc_no"))
    stages.ingest(store, docs.drop("doc_no"))
    return store.read("invoices").select("file_hash")


@query
def s12_store_evolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a file of an older, other width beside the log, and a column that is added later."""
    store = BillingStore(spark, scratch_folder(spark))
    old = X.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("file_name"), F.col("s_suppkey").cast("string").alias("file_hash"), "s_nationkey"
    )
    old.write.parquet(store.path("invoices", "old"))
    store.add_columns("invoices", "c_nationkey int")
    new = X.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("file_name"), F.col("c_custkey").cast("string").alias("file_hash"),
        F.col("c_nationkey").cast("int").alias("c_nationkey"), F.lit(1).alias("not_a_column"),
    )
    store.write("invoices", new, "new")
    found = store.read("invoices").select("file_name", "file_hash", "file_path", "s_nationkey", "c_nationkey")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("s_nationkey", "c_nationkey")})


def _hashed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.invoice_texts(spark, sf_dir).withColumn("file_hash", files.content_hash(F.col("text")))


@query
def s15_exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows as CSV files, read again."""
    folder = scratch_folder(spark)
    export_tables({"rows": stages.extract(_hashed_texts(spark, sf_dir)).rows}, folder, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/rows")
    return back.select("invoice_number", "file_name", F.col("row_number").cast("int").alias("row_number"), "raw_text")


def _rerun(spark: SparkSession, sf_dir: str, **options) -> BillingStore:
    """Two batches through the stages, then the first again with other documents; a third of the orders each."""
    store = BillingStore(spark, scratch_folder(spark))
    inputs = BillingStore(spark, scratch_folder(spark))  # a run drops what its own store has staged
    docs = inputs.stage(_hashed_texts(spark, sf_dir).withColumn("m", F.substring("doc_id", 7, 20).cast("bigint") % 3))
    for batch, third in (("one", 0), ("two", 1), ("one", 2)):
        stages.run_stages(store, docs.where(F.col("m") == third).drop("m"), options=stages.RunOptions(batch=batch, **options))
    return store


@query
def s16_rerun_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table after a batch was run again: nothing is left of its first run."""
    return _rerun(spark, sf_dir, skip_post=True).read("cleaned")


@query
def s17_rerun_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification(_rerun(spark, sf_dir).read("verification"))


@query
def s17_stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = BillingStore(spark, scratch_folder(spark))
    stages.run_stages(store, _hashed_texts(spark, sf_dir))
    return store.read("items").select("invoice_number", "description", "amount", "file_name", "row_number")


@query
def s17_stored_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = BillingStore(spark, scratch_folder(spark))
    stages.run_stages(store, _hashed_texts(spark, sf_dir))
    return store.read("totals").select("invoice_number", "type", "raw", "parsed_amount", "file_name", "row_number")


@query
def s19_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a file of its own, read again."""
    folder = scratch_folder(spark)
    export_texts(X.document_files(spark, sf_dir), folder)
    return read_texts(spark, folder)


@query
def s18_nested_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = stages.postprocess(X.cleaned_rows(spark, sf_dir))
    nested = reconcile.nest_by_invoice(*post)
    return nested.select(
        "invoice_number",
        "file_name",
        joined(F.transform("items", lambda i: i["description"])).alias("items"),
        joined(F.transform("totals", lambda t: F.concat(t["type"], F.lit(":"), t["raw"]))).alias("totals"),
        F.round("verification.parsed_total", 4).alias("parsed_total"),
    )


@query
def s18_invoice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON objects, read again by path."""
    post = stages.postprocess(X.cleaned_rows(spark, sf_dir))
    json = reconcile.to_invoice_json(reconcile.nest_by_invoice(*post))
    return json.select(
        "invoice_number",
        "file_name",
        F.get_json_object("json", "$.invoice_number").alias("json_number"),
        F.json_array_length(F.get_json_object("json", "$.items")).cast("bigint").alias("n_items"),
        F.json_array_length(F.get_json_object("json", "$.totals")).cast("bigint").alias("n_totals"),
        F.get_json_object("json", "$.verification.mismatch_flag").alias("mismatch"),
    )


# --- filters and projections -----------------------------------------------------------

@query
def f1_keep_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.keep_words(X.word_boxes(spark, sf_dir)).select("doc_id", "line_num", "word_idx", "text")


@query
def f2_keep_digit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_digit_lines(document_lines(spark, sf_dir), "line")


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grouping.explode_rows(documents(spark, sf_dir), F.split("text", "\n", -1), "doc_id")
    return lines.withColumnRenamed("item", "raw_text")


@query
def f3_drop_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_summary_rows(_raw_lines(spark, sf_dir))


@query
def f4_drop_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_blank_rows(_raw_lines(spark, sf_dir))


@query
def f5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.split_summary(X.cleaned_rows(spark, sf_dir))[0]


@query
def f5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.split_summary(X.cleaned_rows(spark, sf_dir))[1]


@query
def f6_expected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = X.cleaned_rows(spark, sf_dir).select("invoice_number", "description")
    return merge.evolve_schema(bare, cleaning.CLEANED_SCHEMA).select(
        "invoice_number", "description", "qty", "rate", "amount"
    )


@query
def f7_stamp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.invoice_texts(spark, sf_dir)
    rows = tables.flatten_page_tables(X.page_tables(spark, sf_dir)).withColumn(
        "doc_id", F.concat(F.lit("order_"), "doc_id")
    )
    stamped = fields.stamp_rows(rows, fields.with_fields(docs))
    return stamped.select("invoice_number", "file_name", "row_number", "raw_text")


def _records(docs: DataFrame) -> DataFrame:
    hashed = docs.withColumn("file_hash", files.content_hash(F.col("text")))
    found = stages.extract(hashed, min_confidence=60.0, run_ts="2024-01-01 00:00:00")
    return found.invoices


@query
def f8_invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(X.invoice_texts(spark, sf_dir))


@query
def f8_document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field extraction on free text of four languages."""
    return _records(X.document_files(spark, sf_dir).drop("doc_no", "file_hash"))


# --- aggregations ------------------------------------------------------------------------

@query
def a1_lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_from_words(X.word_boxes(spark, sf_dir)).select("doc_id", "line_num", "raw_text")


@query
def a2_lines_from_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_from_centres(X.word_boxes_plain(spark, sf_dir)).select(
        "doc_id", "line_start", "raw_text"
    )


@query
def a3_rows_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.rows_from_cells(X.cell_boxes(spark, sf_dir))
    return rows.select("doc_id", F.col("line_start").cast("bigint"), "raw_text", joined("cols").alias("cells"))


@query
def a4_keep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.keep_cells(X.cell_boxes(spark, sf_dir)).select("doc_id", "x", "y", "h", "text")


def _paged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.word_boxes(spark, sf_dir).withColumn("page_num", F.floor(F.col("line_num") / 5).cast("int"))


@query
def a5_avg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.avg_confidence(_paged_words(spark, sf_dir)).select("doc_id", rounded("avg_confidence", 6))


@query
def a5_avg_cell_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.avg_confidence(_paged_words(spark, sf_dir), drop_missing=False).select(
        "doc_id", rounded("avg_confidence", 6)
    )


@query
def a6_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fields.row_counts(docs, tables.document_rows(docs))


@query
def a7_totals_per_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = stages.postprocess(X.cleaned_rows(spark, sf_dir))
    return reconcile.nest_by_invoice(*post).select(
        "invoice_number",
        "file_name",
        F.size("items").cast("bigint").alias("n_items"),
        F.size("totals").cast("bigint").alias("n_totals"),
        F.col("verification.mismatch_flag").alias("mismatch_flag"),
    )


@query
def a8_item_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = cleaning.split_summary(X.cleaned_rows(spark, sf_dir))
    return reconcile.item_sums(items).select("invoice_number", rounded("items_sum"))


@query
def w3_first_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 and W3: the first subtotal, tax and total of each invoice."""
    _, totals = cleaning.split_summary(X.cleaned_rows(spark, sf_dir))
    return reconcile.first_totals(totals).select(
        "invoice_number", rounded("subtotal"), rounded("tax"), rounded("total")
    )


@query
def a10_invoice_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.invoice_ids(*cleaning.split_summary(X.cleaned_rows(spark, sf_dir)))


# --- order-dependent operators -------------------------------------------------------------

@query
def w1_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.document_rows(documents(spark, sf_dir))
    return rows.select("doc_id", "row_number", "raw_text", joined("cols").alias("cells"))


@query
def w1_split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in parts of three lines; the rows are those of the whole."""
    lines = F.split("text", "\n", -1)
    parts = F.transform(
        F.sequence(F.lit(1), F.size(lines), F.lit(3)), lambda s: F.array_join(F.slice(lines, s, F.lit(3)), "\n")
    )
    splits = documents(spark, sf_dir).select("doc_id", F.posexplode(parts).alias("split_no", "text"))
    return tables.split_rows(splits).select("doc_id", "row_number", "raw_text", joined("cols").alias("cells"))


@query
def w1_invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.document_rows(X.invoice_texts(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "row_number", "raw_text", joined("cols").alias("cells"))


@query
def w2_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = grouping.keep_first(X.document_files(spark, sf_dir), ["file_hash"], ["doc_no"])
    return first.select("file_hash", "doc_no")


@query
def w4_number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "qty", "cents"]
    items = X.priced_items(spark, sf_dir).select("l_orderkey", *order)
    return grouping.number_rows(items, ["l_orderkey"], order, block=["l_linenumber"])


@query
def w5_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.word_boxes(spark, sf_dir).withColumn("block_num", F.floor(F.col("line_num") / 5).cast("int"))
    return layout.number_lines(layout.lines_from_words(words)).select("doc_id", "line_num", "row_number")


@query
def o1_sorted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sorted_paths(X.document_files(spark, sf_dir))


@query
def o4_first_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", F.substring("text", 1, K.PREVIEW_LENGTH).alias("preview")
    )


# --- scalar functions ------------------------------------------------------------------------

@query
def t1_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir)


@query
def t2_value_after_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents' own prose as keywords, so both passes have hits."""
    return documents(spark, sf_dir).select(
        "doc_id", T.value_after_keywords(F.col("text"), ("invoice", "the on", "cha", "email")).alias("value")
    )


@query
def t3_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *fields.party_columns(F.col("text"), F.lower("text")))


@query
def t4_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.address(F.col("text")).alias("address"))


@query
def t4_address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.coalesce(T.street_address(text), F.lit("")).alias("street"),
        F.coalesce(T.post_box(text), F.lit("")).alias("box"),
        F.coalesce(T.place_with_code(text), F.lit("")).alias("place"),
    )


@query
def t4_invoice_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.invoice_texts(spark, sf_dir).select("doc_id", T.address(F.col("text")).alias("address"))


def _customer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short letters with addresses and invoice numbers in several forms."""
    key = F.col("c_custkey").cast("string")
    name = F.translate("c_name", "#", " ")
    letters = F.array(
        F.concat(name, F.lit("\n"), key, F.lit(" Old Mill Rd, 7th best ave; ref inv-"), key, F.lit(" ok")),
        F.concat(name, F.lit("; mail: p.o.  Box "), key, F.lit("! xinv-1 INV 2x")),
        F.concat(F.lit("Hall: Upper "), name, F.lit(",\n Ham "), F.lpad(key, 5, "1"), F.lit(". INV_"), key),
        F.concat(F.lit("Late: "), key, F.lit(" st, "), name, F.lit(": "), key, F.lit(" a  st. INV - ")),
    )
    customer = X.table(spark, sf_dir, "customer")
    return grouping.explode_rows(customer, letters, "c_custkey").withColumnRenamed("item", "text")


@query
def t4_letter_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_letters(spark, sf_dir).select("c_custkey", "pos", T.address(F.col("text")).alias("address"))


@query
def t6_bare_invoice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = T.invoice_number(F.col("text"), F.col("c_name"))
    letters = _customer_letters(spark, sf_dir).join(X.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return letters.select("c_custkey", "pos", number.alias("invoice_number"))


@query
def t3_conversation_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = X.spread(X.table(spark, sf_dir, "conversations"), "conv_id")
    return turns.select("conv_id", "turn", *fields.party_columns(F.col("text"), F.lower("text")))


@query
def f8_page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as documents: fields and table rows of texts full of signs."""
    stem = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    pages = X.spread(X.table(spark, sf_dir, "pages"), "page_id").select(
        F.col("page_id").cast("string").alias("doc_id"), F.concat(stem, F.lit(".txt")).alias("file_name"),
        F.col("url").alias("file_path"), stem.alias("file_stem"), F.lit(".txt").alias("ext"),
        F.col("html").alias("text"),
    )
    return _records(pages).select(
        "file_name", "invoice_from", "invoice_to", "address", "invoice_number", "salesperson", "table_data_count",
        "raw_text_preview",
    )


@query
def t5_clean_invoice_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    label = F.element_at(
        F.array(*(F.lit(p + " ") for p in ("", "Invoice No:", "INV-", "bill", "inv.", "invoice#", "Bill No"))),
        (F.col("line_no") % 7 + 1).cast("int"),
    )
    return lines.select(
        "doc_id", "line_no", T.clean_invoice_number(F.concat(label, "line")).alias("invoice_number")
    )


@query
def t6_invoice_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.document_files(spark, sf_dir)
    return docs.select("doc_no", T.invoice_number(F.col("text"), F.col("file_stem")).alias("invoice_number"))


@query
def t6_invoice_number_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.invoice_texts(spark, sf_dir)
    return docs.select("doc_id", T.invoice_number(F.col("text"), F.col("file_stem")).alias("invoice_number"))


@query
def t7_row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parse_rows(_raw_lines(spark, sf_dir))
    return rows.select("doc_id", "pos", joined("cols").alias("cells"))


@query
def t8_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).where(T.is_header_line(F.col("line")))


def _number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line item prices in five ways of writing, whole and with a label."""
    items = X.priced_items(spark, sf_dir)
    whole = F.floor(F.col("cents") / 100).cast("bigint")
    thousands = F.when(
        whole >= 1000,
        F.concat(
            F.floor(whole / 1000).cast("bigint").cast("string"), F.lit("#"), F.lpad((whole % 1000).cast("string"), 3, "0")
        ),
    ).otherwise(whole.cast("string"))
    cents = F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    styles = F.array(
        F.col("amount_text"),
        F.concat(F.translate(thousands, "#", ","), F.lit("."), cents),
        F.concat(F.translate(thousands, "#", "."), F.lit(","), cents),
        F.concat(F.lit("€ "), F.translate(F.col("amount_text"), ".", ",")),
        F.concat(F.lit("Part "), F.col("amount_text"), F.lit(" -"), F.col("qty").cast("string")),
        F.lit("no number"),
    )
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(styles).alias("value"))


@query
def t9_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.explode(F.array(*(F.date_format("l_shipdate", f) for f in ("dd.MM.yyyy", "d.M.yy", "yyyy-MM-dd")))).alias("cell")
    )
    return ship.where(T.has_digit(F.col("cell")) & N.looks_like_date(F.col("cell")))


@query
def t10_qty_rate_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.priced_items(spark, sf_dir)
    bar = F.lit(" | ")
    qty = F.col("qty").cast("string")
    three = F.concat(qty, bar, "rate_text", bar, "amount_text")
    forms = F.array(
        F.concat(F.lit("Part P1 | "), three),
        F.concat(F.lit("Qty. "), three),
        F.concat(F.lit("Fee -"), F.translate("amount_text", ".", ","), F.lit(" €")),
        F.concat(F.lit("27.08.2019 | "), three),
        F.concat(F.lit("due 27.08.2019 PO-"), qty, F.lit(" 27.09.2019")),
        F.concat(qty, F.lit(" | x | "), "amount_text"),
        F.lit("none"),
    )
    rows = items.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(forms).alias("raw"))
    return rows.select("*", N.qty_rate_amount(F.col("raw")).alias("v")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "raw", "v.qty", "v.rate", "v.amount"
    )


@query
def t10_document_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = N.qty_rate_amount(F.col("line"))
    return document_lines(spark, sf_dir).select("doc_id", "line_no", v.alias("v")).select(
        "doc_id", "line_no", "v.qty", "v.rate", "v.amount"
    )


@query
def t11_last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select(
        "doc_id", "line_no", N.last_number(F.col("line")).alias("amount")
    )


@query
def t12_normalize_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("l_quantity") / 2
    return X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.normalize_qty(half).alias("qty"),
        N.normalize_qty_text(F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit(",5"))).alias("qty_text"),
        N.normalize_qty_text(F.lit("12d")).alias("qty_bad"),
    )


@query
def t13_normalize_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_texts(spark, sf_dir).select("*", N.normalize_amount(F.col("value")).alias("amount"))


@query
def t14_summary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("description")
    return X.cleaned_rows(spark, sf_dir).where(N.is_summary_description(d)).select(
        "invoice_number", "description", N.summary_type(d).alias("type")
    )


@query
def t15_amount_or_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = N.amount_or_description(F.col("amount"), F.col("description"))
    return X.cleaned_rows(spark, sf_dir).select("invoice_number", "description", amount.alias("amount"))


@query
def t16_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", cleaning.description_of(F.col("text")).alias("description")
    )


@query
def t17_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = layout.avg_confidence(X.word_boxes(spark, sf_dir))
    return average.select("doc_id", N.is_low_confidence(F.col("avg_confidence"), 50.0).alias("low_confidence_flag"))


@query
def t18_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 and T18: items against summary rows per invoice."""
    return verification(reconcile.reconcile(*cleaning.split_summary(X.cleaned_rows(spark, sf_dir))))


# --- stages and streams ------------------------------------------------------------------------

@query
def p1_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages through a store, from invoice texts to the verification table."""
    docs = X.invoice_texts(spark, sf_dir).withColumn("file_hash", files.content_hash(F.col("text")))
    store = BillingStore(spark, scratch_folder(spark))
    return verification(stages.run_stages(store, docs)["verification"])


@query
def p2_extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.invoice_texts(spark, sf_dir).withColumn("file_hash", files.content_hash(F.col("text")))
    return stages.extract(docs).rows.select("invoice_number", "file_name", "row_number", "raw_text")


_PARTS_PER_SPLIT = 8


def _extract_scans(spark: SparkSession, sf_dir: str) -> stages.Extracted:
    """Extraction of scanned orders, intermediate tables written to a scratch store."""
    store = BillingStore(spark, scratch_folder(spark))
    docs, pages = _page_inputs(spark, sf_dir, store)
    return stages.extract(docs, pages, min_confidence=20.0, run_ts="2024-01-01 00:00:00", stage=store.stage)


def _page_inputs(
    spark: SparkSession, sf_dir: str, store: BillingStore
) -> tuple[DataFrame, stages.PageInputs]:
    """Orders as scanned files: text layer, page tables, words and cells, by order number.

    Of every eight, 0-2 have tables, 3-4 cells, 5-6 words only, 7 is an image.
    """
    key = F.col("doc_id").cast("bigint")
    m = key % 8
    texts = store.stage(
        X.invoice_texts(spark, sf_dir).select(
            F.substring("file_stem", 7, 20).alias("doc_id"), "file_stem", "text"
        )
    )
    docs = texts.select(
        "doc_id",
        F.concat("file_stem", F.when(m == 7, ".png").otherwise(".pdf")).alias("file_name"),
        F.concat(F.lit("/in/"), "file_stem").alias("file_path"),
        "file_stem",
        F.when(m == 7, ".png").otherwise(".pdf").alias("ext"),
        files.content_hash(F.col("doc_id")).alias("file_hash"),
        F.lit(None).cast("string").alias("text"),
    )
    pages = texts.select("doc_id", F.lit(1).alias("page_no"), "text")
    one = F.lit(1)
    # dealt out by document as texts, which take a fraction of the room of their words, to tasks enough for these
    dealt = texts.select("doc_id", "text").repartition(_PARTS_PER_SPLIT * texts.rdd.getNumPartitions(), "doc_id")
    lines = grouping.explode_rows(dealt, F.split("text", "\n", -1), "doc_id").select(
        "doc_id", F.col("pos").alias("line_num"), F.col("item").alias("line")
    )
    words = grouping.explode_rows(lines, F.split("line", " ", -1), "doc_id", "line_num").select(
        "doc_id", one.alias("page_num"), one.alias("block_num"), one.alias("par_num"), "line_num",
        F.col("pos").alias("word_idx"), F.col("item").alias("text"), F.col("pos").alias("left"),
        ((key + F.col("pos") * 7) % 101 - 1).cast("double").alias("conf"),
    )
    cells = X.cell_boxes(spark, sf_dir).where(m.isin(3, 4)).withColumn(
        "confs", F.array((F.col("x") / 100 * 3 - 1).cast("double"))
    )
    return docs, stages.PageInputs(
        page_text=pages.where(m.isin(0, 1, 3, 5)),
        page_tables=X.page_tables(spark, sf_dir).where(m <= 2),
        ocr_pages=pages,
        words=words,
        cells=cells,
    )


@query
def p2_extract_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of PDF and image files, from page tables, cells or words."""
    found = _extract_scans(spark, sf_dir)
    return found.rows.select("invoice_number", "file_name", "row_number", "raw_text")


@query
def p2_extract_page_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _extract_scans(spark, sf_dir)
    return found.invoices.withColumn("avg_confidence", rounded("avg_confidence", 6))


@query
def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.document_rows(X.invoice_texts(spark, sf_dir).select("file_name", "file_stem", "text"))
    return stages.clean(rows.withColumnRenamed("file_stem", "invoice_number"))


@query
def p4_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification(stages.postprocess(X.cleaned_rows(spark, sf_dir)).verification)


@query
def p4_any_cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaned table without quantities, rates and order columns."""
    few = X.cleaned_rows(spark, sf_dir).select("invoice_number", "description", "amount")
    return verification(stages.postprocess(few).verification)


@query
def invoice_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to verification in one plan, without a store."""
    rows = stages.rows_of(stages.parse_texts(X.invoice_texts(spark, sf_dir)))
    return verification(reconcile.reconcile_cleaned(stages.clean(rows)))


def _stream_invoices(spark: SparkSession, sf_dir: str, runs: int) -> BillingStore:
    folder = scratch_folder(spark)
    store = BillingStore(spark, f"{folder}/store")
    schema = X.table(spark, sf_dir, "documents").schema
    for run in range(runs):
        docs = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
        stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
        named = docs.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.concat(stem, F.lit(".txt")).alias("file_name"),
            F.concat(F.lit("/in/"), stem, F.lit(".txt")).alias("file_path"),
            stem.alias("file_stem"),
            F.lit(".txt").alias("ext"),
            files.content_hash(F.col("text")).alias("file_hash"),
            "text",
        )
        # a new checkpoint makes the second run see all files again
        ingest_stream(named, store, f"{folder}/checkpoint-{run}").awaitTermination()
    return store


@query
def st1_stream_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_invoices(spark, sf_dir, runs=1).read("invoices").select("file_hash")


@query
def st2_replayed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream twice; the rows are those of one run."""
    rows = _stream_invoices(spark, sf_dir, runs=2).read("rows")
    return rows.select("file_name", "row_number", "raw_text")


@query
def st2_broken_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch that dies after it has written its rows, is run, and is replayed: rows of one run."""
    store = BillingStore(spark, scratch_folder(spark))
    docs = X.document_files(spark, sf_dir).drop("doc_no")
    stages.ingest(store, docs.where(F.col("doc_id").cast("bigint") % 2 == 0), options=stages.RunOptions(batch="epoch-0"))
    dead = store.transaction()  # never committed
    dead.write("rows", store.read("rows").withColumn("raw_text", F.lit("of a run that died")), "epoch-1")
    for _ in range(2):
        stages.ingest(store, docs, options=stages.RunOptions(batch="epoch-1"))
    return store.read("rows").select("file_name", "row_number", "raw_text")
