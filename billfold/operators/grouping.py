"""Shared building blocks: keep-first, running numbers and exploded arrays.

One key may hold a large share of all rows, so nothing here needs a whole group in
one place: keep-first drops rows before the shuffle, running numbers are summed per
block first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], null_keys: bool = True
) -> DataFrame:
    """The first row of each key in the given order (insert-or-ignore).

    ``row_number() = 1`` is planned with a group limit on both sides of the shuffle:
    each map task sends one row per key, however often the key occurs. Rows with a
    null in the key are never duplicates of each other and all stay: each gets a number of
    its own as a part of its key, so that the rows are read once. ``null_keys`` is
    False where there can be none, which saves looking for them.
    """
    rank, own = "__rank", "__own"
    by = list(keys)
    if null_keys:
        whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
        df, by = df.withColumn(own, F.when(~whole, F.monotonically_increasing_id())), [*by, own]
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, ranked).where(F.col(rank) == 1).drop(rank, own)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    block: Sequence[str],
    out: str,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key up to this one.

    ``block`` is a leading part of the order (a page, say). Sums inside a block come
    from a window on ``(keys, block)``; what lies before the block comes from a window
    over one row per block. A hot key is thus spread over its blocks.
    """
    group = [*keys, *block]
    before = "__before"
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*group)
        .agg(F.sum(value).alias("__sum"))
        .select(*group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias(before))
    )
    return (
        df.withColumn(out, F.sum(value).over(upto))
        .join(offsets, group, "inner")
        .withColumn(out, F.col(out) + F.col(before))
        .drop(before)
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Sequence[str], out: str = "row_number"
) -> DataFrame:
    """1-based number of each row within its key."""
    return running_sum(df, keys, order, F.lit(1), block, out).withColumn(out, F.col(out).cast("int"))


def number_in_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_number") -> DataFrame:
    """1-based number of each row within its key, for keys whose rows come from one place, as those of a page image do.

    One pass: the rows are not worked out a second time for the sums of their blocks. Rows with a null in
    the key are left out, as by ``number_rows``.
    """
    known = df.where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    return known.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def explode_rows(df: DataFrame, array: str | Column, *carried: str | Column) -> DataFrame:
    """The carried columns, ``pos`` (from 0) and ``item`` for each element of an array.

    Written as an outer explode whose empty rows are dropped afterwards: for an inner one
    the optimizer adds a test of the array's size below it, which works out an array
    that is itself computed once more.
    """
    return df.select(*carried, F.posexplode_outer(array).alias("pos", "item")).where(F.col("pos").isNotNull())
