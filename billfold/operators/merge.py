"""Insert-or-ignore merges, incremental skip and schema evolution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billfold.operators.grouping import keep_first


_KEY = "__key"


def shared_keys(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__key``: hashes of the keys that incoming rows share with each other or with a stored row.

    A key whose hash is not among them is that of one incoming row and of no stored one. Only the hashes are shuffled.
    """
    number = F.xxhash64(*keys).alias(_KEY)
    both = incoming.select(number, F.lit(1).alias("__new")).unionByName(existing.select(number, F.lit(0).alias("__new")))
    # dealt out first: hardly any key repeats, so there is nothing to add up before the shuffle
    counted = both.repartition(_KEY).groupBy(_KEY).agg(F.sum("__new").alias("__new"), F.count("*").alias("__rows"))
    return counted.where("__new > 0 and __rows > 1").select(_KEY)


def new_rows(
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    null_keys: bool = True,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The incoming rows an insert-or-ignore would add: first of each key, not stored yet.

    Only the key columns of the stored table are read. The join is left to the optimizer,
    which broadcasts the stored keys only when their measured size allows it. ``stage``, which writes a frame and
    reads it back, serves to find the keys that occur more than once beforehand: where these are few, the other
    rows are not shuffled at all. The incoming rows are then read twice.
    """
    by = list(keys)
    if stage is not None and existing is not None:
        shared = stage(shared_keys(existing, incoming, keys))
        if shared.isEmpty():
            return incoming
        number = F.xxhash64(*keys)
        by, keyed = [_KEY, *keys], incoming.withColumn(_KEY, number)
        alone, incoming = (keyed.join(shared, _KEY, how) for how in ("left_anti", "left_semi"))
        existing = existing.select(number.alias(_KEY), *keys).join(shared, _KEY, "left_semi")
    first = keep_first(incoming, by, order, null_keys)
    if existing is None:
        return first
    added = first.join(existing.select(*by), by, "left_anti")
    return added if _KEY not in by else alone.unionByName(added).drop(_KEY)


def merge_ignore(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The stored table after the insert; only columns it has are taken over."""
    added = new_rows(existing, incoming, keys, order)
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in existing.schema.fields
        if f.name not in incoming.columns
    ]
    return existing.unionByName(added.select("*", *missing).select(*existing.columns))


def skip_seen(
    files: DataFrame, invoices: DataFrame | None, force: bool = False, stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Files whose content hash is not stored yet; ``force`` keeps all.

    Equal files within one run both stay: the stored set is as it was before the run.
    The stored hashes are first cut down to those that occur in this run, on the hash
    column alone, so that the side the texts are joined with is as small as it can be
    and the texts need not be shuffled to meet every hash ever stored. ``stage`` may write these hashes and read them
    back, so that their size is known when the join with the texts is planned.
    """
    if force or invoices is None:
        return files
    seen = (
        files.select("file_hash").distinct().join(invoices.select("file_hash"), "file_hash", "left_semi")
    )
    return files.join(stage(seen) if stage else seen, "file_hash", "left_anti").select(*files.columns)


def evolve_schema(df: DataFrame, target: T.StructType | str) -> DataFrame:
    """Adds the target's missing columns as nulls; never drops one."""
    schema = target if isinstance(target, T.StructType) else T.StructType.fromDDL(target)
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns]
    return df.select("*", *added)
