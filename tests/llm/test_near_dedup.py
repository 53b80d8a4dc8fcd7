import random

import pytest
from conftest import prose

from billfold.llm.near_dedup import near_duplicates
from billfold.llm.tables import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    """Component of each row by a plain walk over all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    lowest = {}
    for g, (doc_id, _) in zip(group, rows, strict=True):
        if doc_id is not None:
            lowest[g] = min(lowest.get(g, doc_id), doc_id)
    return [(d, len(s), lowest.get(g), d is not None and d == lowest.get(g)) for g, s, (d, _) in zip(group, sets, rows, strict=True)]


def key(row):
    return tuple((x is None, x) for x in row)


def found(docs):
    out = near_duplicates(docs)
    assert out.columns == ["doc_id", "text_key", "n_shingles", "component_id", "kept"]
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=key)


def test_families_of_copies(docs_of):
    rng = random.Random(3)
    rows, doc_id = [], 1000
    for family in range(12):
        words = prose(family, rng.randrange(5, 300)).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            words = copy if rng.random() < 0.4 else words  # chains as well as stars
            rows.append((doc_id, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
            doc_id -= rng.randrange(1, 5)
    assert found(docs_of(rows)) == sorted(brute(rows), key=key)


def test_odd_rows(docs_of, odd_rows):
    assert found(docs_of(odd_rows)) == sorted(brute(odd_rows), key=key)


def test_exactly_at_the_threshold(docs_of):
    words = [f"w{i}" for i in range(12)]  # nine shingles; eight of ten shared is 0.8
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join([*words[1:-1], "far", "off"]))]
    assert found(docs_of(rows)) == sorted(brute(rows), key=key)


def test_no_rows(docs_of):
    assert found(docs_of([])) == []


@pytest.mark.parametrize("seed", range(3))
def test_components_by_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    group = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in group:
        for a, b in pairs:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    out = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert sorted(map(tuple, out.collect())) == sorted(group.items())


@pytest.mark.parametrize("n", [14, 620])
def test_all_pairs_of_one_bucket_are_decided(docs_of, n):
    rng = random.Random(n)
    base = [f"base{i}" for i in range(60)]
    rows = []
    for i in range(n):  # a family mostly apart: half of it is its own, lengths across several size classes
        rows.append((i, " ".join(base[: rng.randrange(20, 60)] + [f"own{i}x{j}" for j in range(rng.randrange(20, 60))])))
    for i in range(0, n, n // 7):
        rows.append((5000 + i, rows[i][1] + " end"))
    out = near_duplicates(docs_of(rows), bands=1, functions=0)  # one bucket
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=key)
    assert got == sorted(brute(rows), key=key) and sum(not r[3] for r in got) >= 7
