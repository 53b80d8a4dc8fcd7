"""A training-data pipeline over documents: five stages, each by one operator of billfold.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billfold.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from billfold.llm.tables import free_names, reach_package, stored, text_key

SHINGLE = 5  # words of a shingle in the near-duplicate stage


def _same(left: DataFrame, right: DataFrame):
    """Rows of ``left`` with the id and text of ``right``."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (text_key(left["text"]) == right["text_key"])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on the labelled ones among them."""
    reach_package(spark)
    (out,) = free_names(docs, "found")
    found = language_id.identified(docs, language_id.fit(docs), out)
    return found.where(~F.col(f"{out}.rejected")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, a null one last, then the smallest digest of the text; rows without words all stay.

    Two are near-duplicates where they share 80 per cent of their runs of five words.
    Of rows alike in id the one of smallest digest over all columns stays.
    """
    reach_package(spark)
    found = near_dedup.grouped(docs.select("doc_id", "text"), shingle=SHINGLE)
    members = found.where("n_shingles > 0").select("doc_id", "text_key", "component").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    stays = members.groupBy("component").agg(F.min(rank).alias("stays"))
    gone = stored(members.join(stays, "component").where(~rank.eqNullSafe(F.col("stays"))).select("doc_id", "text_key").distinct())
    rest = docs.join(gone, _same(docs, gone), "left_anti")
    repeated = (
        found.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    )
    single = rest.join(repeated, _same(rest, repeated), "left_anti")
    several = rest.join(repeated, _same(rest, repeated), "left_semi")
    digest = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    one = several.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), digest).alias("row"))
    return single.unionByName(one.select("row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars counts what is left."""
    reach_package(spark)
    return line_dedup.without_repeats(docs, length="n_chars")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    reach_package(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents it takes, with their words, their source's and what it takes of them.

    A column that has one of these names already stays, the mix's own is ``__mix_<name>`` then.
    """
    reach_package(spark)
    (sources,) = free_names(docs, "sources")
    mix = mixing.mixed(docs.withColumn(sources, F.array("source")), sources)
    taken = mix.where("taken > 0").groupBy("doc_id", "text_key").agg(
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.max("taken").alias("taken"),
    )
    added = ("size", "source_size", "target", "taken")
    mine = [c if c not in docs.columns else free_names(docs, f"mix_{c}")[0] for c in added]
    columns = [taken[c].alias(name) for c, name in zip(added, mine, strict=True)]
    return docs.join(taken, _same(docs, taken)).select(*(docs[c] for c in docs.columns), *columns)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("line_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", to_target_weights),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
