"""What the operators share: stored intermediate tables and connected components."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import billfold
from billfold.sources.store import scratch_folder

HOT = 1_000  # a key with more than one in so many rows is hot; there are fewer such keys than this

def reach_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if nothing else says where it is."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(billfold.__file__).resolve().parent.parent))


def stored(df: DataFrame) -> DataFrame:
    """The frame written as parquet below ``spark.checkpoint.dir`` and read again.

    This cuts the lineage in a way that survives lost executors, and computes what
    several later steps read once.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column) -> Column:
    """With the id, what tells rows apart: rows alike in both are one document given twice."""
    return F.coalesce(F.xxhash64(F.col(text) if isinstance(text, str) else text), F.lit(0))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names the frame does not have, like the wanted ones; names are told apart without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        free = f"__{name}"
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return out


def dealt_join(rows: DataFrame, one: DataFrame, key: str, counted: DataFrame, total: int) -> DataFrame:
    """``rows`` joined to ``one``, which has a row for each ``key``; the rows of hot keys are dealt out.

    ``counted`` has ``key`` and ``n``, the rows of that key, ``total`` is the number of all rows (or
    more). A key with more than a thousandth of the rows is cut into as many parts as it has
    thousandths, and its row of ``one`` is repeated for each: fewer than ``HOT`` keys are broadcast
    and fewer than twice as many rows are added, whatever the data are. Rows of a null key go.
    """
    share = F.col("n") * HOT / F.lit(max(total, 1))
    hot = counted.where((F.col("n") > 1) & (share > 1)).select(key, F.least(F.ceil(share), "n").cast("int").alias("__parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), "__parts").cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", part).drop("__parts")
    parts = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    each = one.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(parts)).drop("__parts")
    return dealt.join(each, [key, "__part"]).drop("__part")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of the links; the component is its smallest node.

    Large-star and small-star steps in turn, each a partial aggregate and an equi join, until
    nothing changes: about as many rounds as the logarithm of the largest component. Every
    round is a stored table, no node or link comes to the driver.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def signature(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    pairs = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = signature(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u > v").distinct())
        low = smallest(large)
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = signature(pairs)
        if after == before:
            break
        before = after
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
