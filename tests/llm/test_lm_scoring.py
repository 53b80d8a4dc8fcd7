import random
from collections import Counter
from math import floor, log2, log10

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from billfold.llm import lm_scoring as L


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, learns, holds):
    """The model in dictionaries: counts of the kept, weights from the held, then counts of all."""

    def counted(texts):
        one, two, first = Counter(), Counter(), Counter()
        for t in texts:
            ts = tokens(t)
            one.update(ts)
            two.update(zip(["start", *ts], ts, strict=False))
            first.update(["start", *ts][:-1])
        return one, two, first

    def estimates(text, model, v):
        one, two, first = model
        ts = tokens(text)
        for before, word in zip(["start", *ts], ts, strict=False):
            seen = first[before] if before == "start" else one[before]
            bucket = 0 if not seen else min(floor(log2(seen)) + 1, L.CONTEXT_BUCKETS - 1)
            yield bucket, (two[before, word] / max(seen, 1), one[word] / max(sum(one.values()), 1), 1 / (v + 1))

    full = counted(t for d, t in rows if learns(d))
    v = len(full[0])
    kept = counted(t for d, t in rows if learns(d) and not holds(d))
    examples = [e for d, t in rows if learns(d) and holds(d) for e in estimates(t, kept, v)]
    weights = [[1 / 3] * 3 for _ in range(L.CONTEXT_BUCKETS)]
    for _ in range(L.ROUNDS):
        sums = [[1.0] * 3 for _ in weights]
        for bucket, p in examples:
            parts = [w * x for w, x in zip(weights[bucket], p, strict=True)]
            for k in range(3):
                sums[bucket][k] += parts[k] / sum(parts)
        weights = [[x / sum(s) for x in s] for s in sums]
    n = sum(full[0].values())
    for d, t in rows:
        ts = tokens(t)
        base = sum(log10((full[0][w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        score = sum(log10(sum(w * x for w, x in zip(weights[b], p, strict=True))) for b, p in estimates(t, full, v))
        yield d, learns(d), len(ts), sum(full[0][w] > 0 for w in ts), n, base, score


def check(docs, rows, learns, holds, spark_learns, spark_holds, **sizes):
    out = L.scored(docs, spark_learns, spark_holds, **sizes)
    assert out.columns == ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, out.collect()), key=order), sorted(brute(rows, learns, holds), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


@pytest.mark.parametrize("size", [600, 10**9])
def test_against_dictionaries(docs_of, size):
    rng = random.Random(4)
    rows = [(i, prose(i, rng.randrange(60), 50)) for i in range(80)]
    check(
        docs_of(rows), rows, lambda d: d % 4 != 1, lambda d: d % 5 == 0, F.expr("doc_id % 4 <> 1"), F.expr("doc_id % 5 = 0"),
        block_bytes=size, bucket_bytes=size,
    )


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (7, 8)]
    learns, holds = (lambda d: d is not None and d != 5), (lambda d: d == 9)
    check(docs_of(rows), rows, learns, holds, F.expr("doc_id <> 5"), F.expr("doc_id = 9"))


def test_nothing_learned_and_no_rows(docs_of):
    rows = [(1, "a b"), (2, None)]
    check(docs_of(rows), rows, lambda d: False, lambda d: False, F.lit(False), F.lit(True))
    assert L.scored(docs_of([]), F.lit(True), F.lit(True)).collect() == []


def test_packing_is_reversible():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (L.unpack(L.pack(keys)) == keys).all() and len(L.unpack(L.pack(keys[:0]))) == 0
    counts = np.array([0, 1, 2**40])
    assert (L.unpack_counts(L.pack_counts(counts)) == counts).all()
