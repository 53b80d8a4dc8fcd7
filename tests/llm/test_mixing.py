import itertools
import random

import pytest
from conftest import prose
from pyspark.sql import functions as F

from billfold.llm.mixing import mixed, route, targets


def test_targets_reshare_what_is_above_the_cap():
    sizes, weights = [100, 10, 50], [3, 1, 2]
    left, out, open_ = 1.5 * sum(sizes), [0.0] * 3, [0, 1, 2]
    while open_:  # as the rule is worded: share, cap, share the excess again
        share = {i: weights[i] * left / sum(weights[j] for j in open_) for i in open_}
        above = [i for i in open_ if share[i] > 2 * sizes[i]]
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in above]
    assert targets(sizes, weights, 1.5, 2) == pytest.approx(out)
    assert sum(out) == pytest.approx(240)
    assert targets([0, 0], [3, 1], 1.5, 2) == [0.0, 0.0]


@pytest.mark.parametrize("seed", range(30))
def test_flows_are_largest_and_cheapest(seed):
    rng = random.Random(seed)
    capacity = [rng.randrange(4) for _ in range(3)]
    members = [sorted(rng.sample(range(3), rng.randrange(1, 4))) for _ in capacity]
    demand = [rng.randrange(5) for _ in range(3)]

    def fits(given):  # Hall's condition: every set of sources takes no more than it is given and wants
        sets = [s for n in range(4) for s in itertools.combinations(range(3), n)]
        return all(sum(g for g, m in zip(given, members, strict=True) if set(m) <= set(s)) <= sum(demand[i] for i in s) for s in sets)

    def cost(given):
        return sum(max(0, g - c) for g, c in zip(given, capacity, strict=True))

    able = [g for g in itertools.product(*(range(2 * c + 1) for c in capacity)) if fits(g)]
    best = min(able, key=lambda g: (-sum(g), cost(g)))
    got = route(capacity, members, demand, 2)
    assert fits(got) and (sum(got), cost(got)) == (sum(best), cost(best))


def test_sources_come_near_their_targets(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randrange(1, 40)), "en", rng.choice(["a", "a", "a", "B", "ü", None])) for i in range(400)]
    docs = docs_of(rows).withColumn("s", F.array("source"))
    out = mixed(docs, "s").collect()
    assert len(out) == 400
    for source in ("a", "B", "ü", None):
        mine = [r for r in out if r.sources == [source]]
        assert all(r.size == len(rows[r.doc_id][1].split()) and r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    again = mixed(docs.repartition(7), "s").collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in out}


def test_overlapping_sources_repeat_less(docs_of):
    rows = [(i, "one two", "en", "x") for i in range(300)]
    docs = docs_of(rows).withColumn("s", F.when(F.col("doc_id") < 100, F.array(F.lit("a"))).when(F.col("doc_id") < 200, F.array(F.lit("b"), F.lit("a"))))
    out = {r.doc_id: r for r in mixed(docs, "s", weights=(1,), share=1.0).collect()}
    assert all(out[i].taken == 0 for i in range(200, 300))  # in no source
    assert sum(out[i].taken for i in range(100, 200)) >= 200 and sum(r.taken for r in out.values()) == 600


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of([(*r, "en", None) for r in odd_rows]).withColumn("s", F.array("source"))
    out = mixed(docs, "s").collect()
    assert len(out) == len(odd_rows) and {r.size for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert mixed(docs_of([]).withColumn("s", F.array("source")), "s").collect() == []
