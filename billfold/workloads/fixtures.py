"""Billing inputs (D1-D7 of FIXTURES.md) derived from the given tables.

Numbers go into text through decimals and whole cents only, so that every engine
prints the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billfold.operators.grouping import explode_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over all cores, if the scan has fewer tasks than there are cores.

    One task is too few for work that is bound by the CPU; a large table has tasks enough
    and is read as it is, without a shuffle. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _cents_text(cents: Column) -> Column:
    return F.concat(
        F.floor(cents / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"),
    )


def priced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with whole quantity, price and rate in cents and as text."""
    cents = (F.col("price") * 100).cast("bigint")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    raw = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_extendedprice")
    return (
        spread(raw, "l_orderkey")
        .select(
            *keys,
            F.col("l_quantity").cast("int").alias("qty"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        )
        .withColumn("cents", cents)
        .withColumn("rate_cents", F.expr("cents div qty"))
        .withColumn("rate_text", _cents_text(F.col("rate_cents")))
        .withColumn("amount_text", F.col("price").cast("string"))
    )


def _rate(cents: Column, qty: Column) -> Column:
    return F.call_function("div", cents, qty)


def _item_line(item: Column) -> Column:
    cents, qty = item["cents"], item["qty"]
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Part P"), item["l_partkey"].cast("string")),
        qty.cast("string"),
        _cents_text(_rate(cents, qty)),
        (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("string"),
    )


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: doc_id, file_name, file_path, file_stem, ext, text, one text per order."""
    # gathered as numbers: the line of an item follows from them and would take the larger part of the shuffle
    lines = priced_items(spark, sf_dir).groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "qty", "cents"))).alias("ls"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = F.col("o_orderkey").cast("string")
    head = F.array(
        F.concat(F.lit("Invoice No: INV-"), key),
        F.concat(F.lit("From: Supplier "), F.coalesce("suppkey", F.lit(0)).cast("string")),
        F.concat(F.lit("To: "), F.col("c_name")),
        F.lit("Description | Qty | Rate | Amount"),
    )
    tax = F.concat(
        F.lit("Sales Tax "), F.pmod("o_orderkey", F.lit(500)).cast("decimal(18,2)").cast("string")
    )
    foot = F.array(
        F.concat(F.lit("Balance Due "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.lit("Page 1"),
    )
    body = F.coalesce(F.transform("ls", _item_line), F.array().cast("array<string>"))
    stem = F.concat(F.lit("order_"), key)
    return (
        # the texts grow with the data, while their estimated size does not show it
        # and they are joined last, so that they are shuffled once
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
        .join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            stem.alias("file_stem"),
            F.array_join(F.concat(head, body, F.array(tax), foot), "\n").alias("text"),
        )
        .select(
            F.col("file_stem").alias("doc_id"),
            F.concat("file_stem", F.lit(".txt")).alias("file_name"),
            F.concat(F.lit("/in/"), "file_stem", F.lit(".txt")).alias("file_path"),
            "file_stem",
            F.lit(".txt").alias("ext"),
            "text",
        )
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2: the documents as text files with their content hash."""
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(stem, F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("/in/"), stem, F.lit(".txt")).alias("file_path"),
        stem.alias("file_stem"),
        F.lit(".txt").alias("ext"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        "text",
        F.col("doc_id").alias("doc_no"),
    )


def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: a cleaned table with summary rows of every type, missing and repeated."""
    items = priced_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("o"),
        F.concat(F.lit("Part P"), F.col("l_partkey").cast("string")).alias("description"),
        F.col("qty").cast("double").alias("qty"),
        (F.col("rate_cents").cast("decimal(18,0)") / 100).cast("double").alias("rate"),
        F.col("price").cast("double").alias("amount"),
        F.concat_ws("_", F.lit("a"), "l_linenumber", "l_partkey", "l_suppkey", "qty", "cents").alias("file_name"),
        F.lit(1).alias("row_number"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("o"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    o = F.col("o")
    subtotal = F.col("price") - F.when(F.pmod(o, F.lit(5)) == 3, F.lit(1)).otherwise(0)
    tax = F.pmod(o, F.lit(500)).cast("decimal(18,2)")

    def row(name: str, value: Column, place: int) -> Column:
        text = value.cast("decimal(18,2)")
        in_text = F.pmod(o, F.lit(7)) < 3
        return F.struct(
            F.when(in_text, F.concat(F.lit(name + " "), text.cast("string"))).otherwise(name).alias("description"),
            F.when(~in_text, text.cast("double")).alias("amount"),
            F.lit(place).alias("row_number"),
        )

    kind = F.pmod(o, F.lit(6))
    rows = (
        F.when(kind == 0, F.array(row("Subtotal", subtotal, 1), row("VAT", tax, 2), row("Total", F.col("price"), 3)))
        .when(kind == 1, F.array(row("Total", F.col("price"), 1), row("Sales Tax", tax, 2)))
        .when(kind == 2, F.array(row("Subtotal", subtotal, 1), row("GST", tax, 2)))
        .when(kind == 3, F.array(row("Tax", tax, 1), row("Tax 2", subtotal, 2)))
        .when(kind == 4, F.array(row("Total", F.col("price"), 1), row("Grand Total", subtotal, 2)))
    )
    null = F.lit(None).cast("double")
    summary = orders.select("o", F.explode(rows).alias("r")).select(
        "o", "r.description", null.alias("qty"), null.alias("rate"), "r.amount",
        F.lit("b").alias("file_name"), "r.row_number",
    )
    invoice = F.concat(F.lit("N"), o.cast("string")).alias("invoice_number")
    return items.unionByName(summary).select(
        invoice, "description", "qty", "rate", "amount", "file_name", "row_number"
    )


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4: words of the documents with layout keys, positions and confidence."""
    docs = documents(spark, sf_dir)
    lines = explode_rows(docs, F.split("text", "\n", -1), "doc_id").select("doc_id", F.col("pos").alias("line_no"), "item")
    words = explode_rows(lines, F.split("item", " ", -1), "doc_id", "line_no").select(
        "doc_id", "line_no", F.col("pos").alias("word_idx"), F.col("item").alias("text")
    )
    conf = F.pmod(F.col("doc_id") * 31 + F.col("word_idx") * 17, F.lit(102)) - 1
    return words.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(1).alias("page_num"),
        F.lit(1).alias("block_num"),
        F.lit(1).alias("par_num"),
        F.col("line_no").alias("line_num"),
        "word_idx",
        F.pmod(F.col("word_idx") * 37, F.lit(10007)).cast("int").alias("left"),
        (F.col("line_no") * 20 + F.pmod("word_idx", F.lit(3))).cast("int").alias("top"),
        F.lit(12).alias("height"),
        "text",
        conf.cast("double").alias("conf"),
    )


def word_boxes_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: the same boxes without the keys of block, paragraph and line."""
    return word_boxes(spark, sf_dir).drop("block_num", "par_num", "line_num")


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6: four cells per line item, one grid row per line number and part."""
    items = priced_items(spark, sf_dir)
    texts = F.array(
        F.concat(F.lit("Part P"), F.col("l_partkey").cast("string")),
        F.when(F.col("qty") % 7 == 0, F.lit(" ")).otherwise(F.col("qty").cast("string")),
        F.col("rate_text"),
        F.col("amount_text"),
    )
    return items.select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.lit(1).alias("page_num"),
        "l_partkey", "l_linenumber", "l_suppkey", "cents",
        F.posexplode(texts).alias("k", "text"),
    ).select(
        "doc_id",
        "page_num",
        (F.col("k") * 100).alias("x"),
        (F.col("l_linenumber") * 40 + F.col("l_partkey") % 5).cast("int").alias("y"),
        F.lit(50).alias("w"),
        (F.lit(18) + (F.col("cents") + F.col("k")) % 7).cast("int").alias("h"),
        "text",
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7: five lines of a document are a page; the pages of every fourth document are blank."""
    pages = _pages(documents(spark, sf_dir))
    blank = F.col("doc_id").cast("bigint") % 4 == 3
    return pages.withColumn("text", F.when(blank, " \n ").otherwise(F.col("text")))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7: OCR text of the same pages, for all documents."""
    return _pages(documents(spark, sf_dir))


def _pages(docs: DataFrame) -> DataFrame:
    lines = F.split("text", "\n", -1)
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(5))
    pages = F.transform(starts, lambda s: F.array_join(F.slice(lines, s, F.lit(5)), "\n"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(pages).alias("p", "text")).select(
        "doc_id", (F.col("p") + 1).alias("page_no"), "text"
    )


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7: one table per order and line number, with a header row and null cells."""
    items = priced_items(spark, sf_dir)

    def cells(item: Column) -> Column:
        return F.array(
            F.when(item["l_partkey"] % 11 != 0, F.concat(F.lit(" Part P"), item["l_partkey"].cast("string"))),
            item["qty"].cast("string"),
            _cents_text(item["rate_cents"]),
            F.concat(item["price"].cast("string"), F.lit(" ")),
        )

    header = F.array(*(F.lit(h) for h in ("Description", "Qty", "Rate", "Amount")))
    keyed = F.struct("l_partkey", "l_suppkey", "qty", "price", "rate_cents")
    return (
        items.groupBy("l_orderkey", "l_linenumber")
        .agg(F.transform(F.sort_array(F.collect_list(keyed)), cells).alias("body"))
        .select(
            F.col("l_orderkey").cast("string").alias("doc_id"),
            F.col("l_linenumber").alias("page_no"),
            F.lit(1).alias("table_no"),
            F.concat(F.array(header), "body").alias("rows"),
        )
    )
