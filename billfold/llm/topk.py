"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks, and so are queries; each pair of blocks is one group. In a group each
dimension's rows are a sorted list, read from its high end where the query is positive and from
its low end where it is negative, all lists to the same depth. No unread row can score more
than the query's product with the values at that depth; reading stops when that is less than the k-th
best score, so rows that tie with it and have a smaller id are found too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 1_024
SCALE = 256
FIRST_DEPTH = 16


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def threshold_search(rows: np.ndarray, order: np.ndarray, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best rows, ties to the smaller place, and the rows scored.

    ``order`` holds each dimension's places by rising value, ``own`` marks rows out of question.
    """
    used = np.flatnonzero(query)
    n, depth, best, scores = len(rows), FIRST_DEPTH, np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    seen = own.copy()
    done = 0
    while True:
        upto = min(depth, n) if len(used) else n
        ahead = np.arange(done, upto)
        places = np.where(query[used] > 0, n - 1 - ahead[:, None], ahead[:, None])
        met = np.zeros(n, bool)
        met[order[places, used].ravel() if len(used) else ahead] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        best = np.concatenate([best, new])
        scores = np.concatenate([scores, rows[new] @ query])
        if len(best) > k:
            kept = np.lexsort((best, -scores))[:k]
            best, scores = best[kept], scores[kept]
        done = upto
        if done == n:
            break
        edge = np.where(query[used] > 0, n - done, done - 1)
        bound = rows[order[edge, used], used] @ query[used]
        if len(best) == k and bound < scores.min():
            break
        depth *= 2
    kept = np.lexsort((best, -scores))
    return best[kept], scores[kept], int(seen.sum())


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = SCALE,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k best rows other than its own.

    Both frames are ``(vec_id, embedding)``; a component x counts as floor(scale * x). A query's own rows are those of
    its id. Ties go to the smaller id. Rows with a null id, a null vector or a null or non-finite
    component take no part; only vectors of equal length are compared; repeated candidates are
    ranked each, a repeated query is answered once. Products must fit a long. Other columns are
    not looked at.
    """

    def usable(df: DataFrame) -> DataFrame:
        plain = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
        rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(plain)
        return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))

    rows, queries = usable(rows), usable(queries).distinct()
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // rows_per_block)), max(1, -(-n_queries // queries_per_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(
        "vec_id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks)).cast("int").alias("r"), spread(query_blocks).alias("q")
    )
    asked = queries.select(
        "vec_id", "v", F.lit(True).alias("asks"), spread(row_blocks).alias("r"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).cast("int").alias("q")
    )

    def search(group: pa.Table) -> pa.Table:
        dims = len(group["v"][0])
        ids = group["vec_id"].to_numpy()
        asks = group["asks"].to_numpy(zero_copy_only=False)
        values = matrix(group["v"], dims)
        by_id = np.argsort(ids[~asks], kind="stable")
        row_ids, data = ids[~asks][by_id], values[~asks][by_id]
        wanted = values[asks]
        top = float(np.abs(data).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * max(dims, 1)
        if top < 2**24:
            data, wanted = data.astype(np.float32), wanted.astype(np.float32)
        elif top < 2**53:
            data, wanted = data.astype(np.float64), wanted.astype(np.float64)
        order = np.argsort(data, axis=0, kind="stable").astype(np.int32)
        out: list[tuple[np.ndarray, ...]] = []
        for query_id, query in zip(ids[asks].tolist(), wanted, strict=True):
            own = row_ids == query_id
            if not own.all():
                places, scores, _ = threshold_search(data, order, query, k, own)
                key = np.full(len(places), zlib.crc32(query.astype(np.float64).tobytes()))
                out.append((np.full(len(places), query_id), key, row_ids[places], scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_id", "key", "vec_id", "score"), columns, strict=True)))

    cells = candidates.unionByName(asked).withColumn("dims", F.size("v"))
    found = cells.groupBy("dims", "r", "q").applyInArrow(search, "query_id bigint, key bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
