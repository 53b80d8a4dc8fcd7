"""The operators' queries: each applies one of them to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billfold.llm import (
    alignment,
    chat_format,
    decontamination,
    exact_dedup,
    html_extraction,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    spelling,
    token_counts,
    topk,
)
from billfold.llm.tables import reach_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_units(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("__sources", F.array("source"))
    return mixing.mixed(docs, "__sources").drop("text_key", "sources")


@query
def op6_centroid_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = docs.withColumn("__held_out", F.coalesce(held_out, F.lit(False)))
    model = language_id.fit(rows.where(~F.col("__held_out")))
    found = language_id.identified(rows.select("doc_id", "__held_out", "text"), model, "__found")
    return found.select("doc_id", F.col("__held_out").alias("held_out"), "__found.*")


@query
def op2_resync_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.read_back(chat_format.formatted(turns))


@query
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    learns = F.coalesce(F.pmod(crc, F.lit(5)) != 1, F.lit(True))
    found = lm_scoring.scored(table(spark, sf_dir, "documents"), learns, F.pmod(crc, F.lit(25)) == 0)
    return found.withColumn("held_out", ~F.col("learned")).drop("learned")


@query
def op8_boosted_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extracted(pages, html_extraction.fit(pages))


@query
def op11_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query
def op12_composed_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(table(spark, sf_dir, "documents"), *paths)
