import random
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from billfold.llm.topk import threshold_search, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string, q int, r int, v string, dims int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "s", "r", 1, 2, "v", 3) for i, e in rows], SCHEMA)


def brute(rows, queries, k):
    plain = [(i, [floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and isfinite(x) for x in e)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in plain if (i, tuple(q)) in {(a, tuple(b)) for a, b in plain} and queries(i)}:
        best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in plain if j != i and len(v) == len(q)))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16_384, 1024), (40, 3)])
def test_against_all_products(spark, blocks):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(i, [0.0] * 8) for i in range(450, 460)]  # ties
    df = frame(spark, rows)
    out = top_k(df, df.where("vec_id % 10 = 0"), 5, rows_per_block=blocks[0], queries_per_block=blocks[1])
    assert sorted(map(tuple, out.collect())) == brute(rows, lambda i: i % 10 == 0, 5)


def test_odd_rows(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    rows += [(None, [1.0, 1.0]), (100, [1.0]), (6, [2.0]), (150, []), (7, []), (200, [3e38, -3e38]), (0, [-0.001, 0.0])]
    df = frame(spark, rows)
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 50 = 0").where("vec_id <> 200"), 2).where("query_id <> 0").collect()}
    assert out[50, 1][0] in (1, 200) and out[100, 1] == (6, 131072) and out[150, 1] == (7, 0) and (150, 2) not in out
    few = frame(spark, [r for r in rows if r[0] != 200])
    got = top_k(few, few.where("vec_id % 50 = 0"), 5).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [(1, 1, 98304), (2, 1, 98304), (3, 0, -256)]
    empty = frame(spark, [])
    assert top_k(empty, empty).collect() == []


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(0)
    rows = rng.integers(-100, 100, (5000, 3)).astype(np.float64)
    rows[4321] = [500, -500, 500]
    query = np.array([1.0, -1.0, 1.0])
    places, scores, read = threshold_search(rows, np.argsort(rows, axis=0, kind="stable"), query, 1, np.zeros(5000, bool))
    assert places.tolist() == [4321] and scores.tolist() == [1500] and read < 200
