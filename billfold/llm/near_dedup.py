"""Near-duplicate documents by min-max hashing.

Every hash function of a document's shingles gives two signature values, its smallest and
its largest hash, so half as many functions are evaluated as a plain MinHash needs. Bands of
signature values propose pairs; each pair proposed is confirmed on the two whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import components, stored, text_key

SHINGLE = 4
PERCENT = 80
BANDS = 48
FUNCTIONS_PER_BAND = 3  # six signature values a band
LARGE = 16  # a bucket of more nodes is decided in blocks
PART_NODES, PART_SHINGLES = 512, 1 << 20  # of a part of a cluster, about
COLUMNS = 4096  # shingles counted at once


def distinct_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their bounds."""
    all_of, bounds = W.shingles(*W.words_of(column), n)
    sets = [np.unique(all_of[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    ends = np.cumsum([0, *(len(s) for s in sets)])
    return (np.concatenate(sets) if sets else all_of), ends


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, functions: int) -> np.ndarray:
    """A row of ``bands`` 64-bit keys for each non-empty set; equal keys, equal minima and maxima."""
    rng = np.random.default_rng(7)
    keys = np.empty((len(starts), bands), np.uint64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for _ in range(functions):
            factor = np.uint32(rng.integers(0, 1 << 32, dtype=np.uint64) | 1)
            moved = short * factor
            for edge in (np.minimum, np.maximum):
                key = W.mix(key ^ edge.reduceat(moved, starts).astype(np.uint64))
        keys[:, band] = key
    return keys


def features(docs: DataFrame, shingle: int, bands: int, functions: int) -> DataFrame:
    """``(doc_id, text_key, n_shingles, node, keys)``: equal sets have the same node, a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.sliced(batches, "text"):
            hashes, bounds = distinct_shingles(part["text"], shingle)
            count = np.diff(bounds)
            full = np.flatnonzero(count)
            nodes: list[bytes | None] = [None] * len(count)
            keys: list[np.ndarray | None] = [None] * len(count)
            if len(full):
                starts = bounds[:-1][full]
                digest = np.stack([np.add.reduceat(W.mix(hashes, s), starts) for s in (1, 2)], axis=1)
                rows = band_keys(hashes, starts, bands, functions).view(np.int64)
                for i, row in enumerate(full):
                    nodes[row], keys[row] = digest[i].tobytes(), rows[i]
            columns = (pa.array(count, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], *columns], names=["doc_id", "text_key", "n_shingles", "node", "keys"]
            )

    schema = "doc_id bigint, text_key bigint, n_shingles bigint, node binary, keys array<bigint>"
    return docs.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs ``(a, b)`` whose whole shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.sliced(batches, "text_a"):
            a, at = distinct_shingles(part["text_a"], shingle)
            b, bt = distinct_shingles(part["text_b"], shingle)
            alike = []
            for i in range(part.num_rows):
                x, y = a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def decided_blocks(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(a, b)``: connections among ``nodes(node, n_shingles, component, cluster)``, all pairs of a cluster tested.

    A cluster is cut by size, so that two nodes alike enough are in one class or in neighbouring
    ones, and a class by hash into parts of bounded size; every two parts that can hold a pair meet in one
    group of two parts at most, where the shared shingles of all pairs are counted at once. A group
    returns one row at most for a node: the smallest node that its links there lead to.
    """
    several = nodes.groupBy("cluster").agg(F.min("component").alias("m"), F.max("component").alias("x")).where("m < x")
    open_ = nodes.join(several, "cluster", "left_semi")
    # of two sizes alike enough the smaller has percent / 100 of the larger: one class apart at most, the base a little wider
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100.0 / percent) * 1.0001 + 1e-6)).cast("int")
    classed = stored(open_.withColumn("size", size))
    parts = F.greatest(F.ceil(F.count("*") / PART_NODES), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("int")
    per_class = stored(classed.groupBy("cluster", "size").agg(parts.alias("parts")))
    after = per_class.select("cluster", (F.col("size") - 1).alias("size"), F.col("parts").alias("after"))
    before = per_class.select("cluster", (F.col("size") + 1).alias("size"), F.col("parts").alias("before"))
    near = per_class.join(after, ["cluster", "size"], "left").join(before, ["cluster", "size"], "left").na.fill(0, ["after", "before"])
    placed = classed.join(near, ["cluster", "size"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))

    def unit(size, part, other, other_part, side):
        names = ("size", "part", "other", "other_part", "side")
        return F.struct(*(c.cast("int").alias(n) for c, n in zip((size, part, other, other_part, side), names, strict=True)))

    def each(count, of):
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), of)

    here, own = F.col("size"), F.col("part")
    within = each("parts", lambda j: unit(here, F.least(own, j), here, F.greatest(own, j), F.when(own > j, 1).otherwise(0)))
    upward = each("after", lambda j: unit(here, own, here + 1, j, F.lit(0)))
    downward = each("before", lambda j: unit(here - 1, j, here, own, F.lit(1)))
    rows = placed.select("node", "component", "cluster", F.explode(F.concat(within, upward, downward)).alias("u")).select("node", "component", "cluster", "u.*")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.sliced(batches, "text"):
            hashes, at = distinct_shingles(part["text"], shingle)
            held = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(held, pa.binary())], ["node", "hashes"])

    hashed = texts.join(classed, "node", "left_semi").select("node", "text").mapInArrow(sets, "node binary, hashes binary")

    def tested(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        side, alone = rows["side"].to_numpy(), (rows["size"][0], rows["part"][0]) == (rows["other"][0], rows["other_part"][0])
        left, right = (np.arange(len(rows)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        held = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        count = np.array([len(h) for h in held])
        shared = shared_counts([held[i] for i in left], [held[i] for i in right])
        alike = 100 * shared >= percent * (count[left][:, None] + count[right][None, :] - shared)
        group = pd.factorize(rows["component"])[0]
        x, y = np.nonzero(alike & (group[left][:, None] != group[right][None, :]))
        x, y = left[x], right[y]
        low, old = np.arange(len(rows)), None
        while old is None or (low != old).any():
            old = low.copy()
            np.minimum.at(low, x, old[y])
            np.minimum.at(low, y, old[x])
        moved = np.flatnonzero(low != np.arange(len(rows)))
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[low[moved]], "b": node[moved]})

    units = rows.join(hashed, "node")
    return units.groupBy("cluster", "size", "part", "other", "other_part").applyInPandas(tested, "a binary, b binary").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    of_x, of_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (left, right))
    at_x, at_y = np.searchsorted(both, x), np.searchsorted(both, y)
    for begin in range(0, len(both), COLUMNS):
        some = both[begin : begin + COLUMNS]
        halves = []
        for values, of, at, n in ((x, of_x, at_x, len(left)), (y, of_y, at_y, len(right))):
            inside = (at >= begin) & (at < begin + len(some))
            column = at[inside] - begin
            hit = some[column] == values[inside]
            half = np.zeros((n, len(some)), np.float32)
            half[of[inside][hit], column[hit]] = 1
            halves.append(half)
        out += (halves[0] @ halves[1].T).astype(np.int64)
    return out


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    functions: int = FUNCTIONS_PER_BAND,
) -> DataFrame:
    """``grouped`` without its ``component``: ``(doc_id, text_key, n_shingles, component_id, kept)``."""
    return grouped(docs, shingle, percent, bands, functions).drop("component")


def grouped(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    functions: int = FUNCTIONS_PER_BAND,
) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component, component_id, kept)``, a row for each row of ``docs(doc_id, text)``.

    A set is the distinct runs of ``shingle`` words; of fewer words, all of them; without words
    or with a null text it is empty, and such a row is linked with nothing. Documents whose
    sets share ``percent`` of their union are linked; ``component_id`` is the smallest doc_id
    that can be reached, ``kept`` holds where that is the document itself. Rows with equal ids
    are told apart by their texts; a null id is never a component_id unless it stands alone, and such rows
    are not kept by this column; ``component`` is the digest of one node of the group, null only for an empty set. Other columns of ``docs`` are not looked at.

    Equal sets are one node. Every pair of nodes that share a bucket (a band key) is decided, by
    a test on the whole sets or as both are already connected. Nodes are first tested with the node that
    comes first in most of their buckets. Buckets of more than ``LARGE`` nodes are joined to clusters where they share
    a node, and all pairs of a cluster are counted in blocks, without a row for each pair; what is left
    are pairs of small buckets. A pair of similarity 0.8 meets in no bucket with a probability
    of 5 in 10 million at 48 bands of six values.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key("text").alias("text_key"))
    rows = stored(features(docs, shingle, bands, functions))
    full = rows.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.first("keys").alias("keys"),
        F.min(F.struct("doc_id", "text_key")).alias("row"),
        F.first("n_shingles").alias("n_shingles"),
    )
    members = nodes.select("node", "row", "n_shingles", F.explode("keys").alias("key"))
    near = Window.partitionBy("key").orderBy("node")
    met = members.withColumn("lone", F.lag("node").over(near).isNull() & F.lead("node").over(near).isNull())
    buckets = stored(met.where("not lone").drop("lone"))

    wanted = buckets.groupBy("row").agg(F.first("node").alias("node"))
    key = (F.col("w.row.doc_id").eqNullSafe(F.col("d.doc_id"))) & (F.col("w.row.text_key") == F.col("d.text_key"))
    found = docs.alias("d").join(wanted.alias("w"), key).select("w.node", "d.text")
    texts = stored(found.groupBy("node").agg(F.first("text").alias("text")))

    first = buckets.withColumn("first", F.first("node").over(near)).where("first < node")
    ranked = first.groupBy("node", "first").agg(F.count("*").alias("n"))
    tested = ranked.groupBy("node").agg(F.max(F.struct("n", "first")).alias("top"))
    tested = stored(tested.select(F.col("top.first").alias("a"), F.col("node").alias("b")))
    links = stored(confirmed(tested, texts, shingle, percent))
    label = stored(components(links))

    large = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where(F.col("n") > LARGE)
    spokes = buckets.join(large.select("key", "head"), "key").select(F.col("head").alias("a"), F.col("node").alias("b"))
    cluster = stored(components(spokes.where("a <> b").distinct()).withColumnRenamed("component", "cluster"))
    sizes = buckets.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"))
    clustered = cluster.join(sizes, "node").join(label, "node", "left")
    clustered = clustered.select("node", "n_shingles", "cluster", F.coalesce("component", "node").alias("component"))
    found = stored(decided_blocks(clustered, texts, shingle, percent))
    if not found.isEmpty():
        links = stored(links.unionByName(found))
        label = stored(components(links))

    told = buckets.join(large, "key", "left_anti").join(label, "node", "left").join(cluster, "node", "left")
    told = stored(told.select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"), "cluster"))
    x, y = told.alias("x"), told.alias("y")
    open_pair = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    open_pair &= ~F.coalesce(F.col("x.cluster") == F.col("y.cluster"), F.lit(False))
    for one, other in (("x", "y"), ("y", "x")):
        open_pair &= 100 * F.col(f"{one}.n_shingles") >= percent * F.col(f"{other}.n_shingles")
    pairs = x.join(y, open_pair).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
    new = stored(confirmed(pairs, texts, shingle, percent))
    if not new.isEmpty():
        label = stored(components(links.unionByName(new)))
    lowest = label.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = label.join(lowest, "component").select("node", "component", "lowest")
    whole = nodes.select("node", "first_id").join(named, "node", "left")
    ids = whole.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("lowest", "first_id").alias("lowest"))
    out = rows.select("doc_id", "text_key", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "text_key", "n_shingles", "component", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
