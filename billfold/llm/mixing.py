"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents with the same set of sources are one pattern. Words flow from patterns to the sources
they are members of, each source takes its target; the n-th repetition of a pattern costs n per
word, so a flow of least cost repeats as little as it can. The graph has a node per pattern and
per source, never per document; documents are then chosen in a seeded order until their
pattern's flow is met.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billfold.llm.tables import stored, text_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
LISTED = 100_000  # patterns that are broadcast at most; more are joined
BINS = 4096


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """``share`` of all sizes by weight, none above ``most`` times its size, the excess shared again by weight.

    With the sources in order of cap by weight, those before some place stop at their caps and
    the rest share what is left: the place is the first where none of the rest is above its cap.
    """
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = min(share * sum(sizes), sum(caps)), float(sum(weights))
    out = [0.0] * len(sizes)
    for i in order:
        level = left / weight
        if caps[i] <= weights[i] * level:
            out[i] = float(caps[i])
            left -= caps[i]
            weight -= weights[i]
        else:
            for j in order[order.index(i) :]:
                out[j] = weights[j] * level
            break
    return out


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], demand: Sequence[int], copies: int) -> list[int]:
    """Words each pattern gives: a maximum flow to the sources' demands at least cost.

    Successive shortest paths with potentials over pattern and source nodes; each of a pattern's
    ``copies`` is an edge of its capacity that costs one more a word than the one before. Parts
    of the graph that share no source are solved one by one.
    """
    root = list(range(len(demand)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for sources in members:
        for other in sources[1:]:
            root[find(other)] = find(sources[0])
    parts: dict[int, list[int]] = defaultdict(list)
    for p, sources in enumerate(members):
        parts[find(sources[0])].append(p)
    given = [0] * len(capacity)
    for patterns in parts.values():
        for p, words in zip(patterns, _cheapest(capacity, members, demand, copies, patterns), strict=True):
            given[p] = words
    return given


def _cheapest(capacity, members, demand, copies, patterns) -> list[int]:
    sources = sorted({s for p in patterns for s in members[p]})
    node = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    edges: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]

    def edge(a: int, b: int, most: int, price: int) -> None:
        for start, end, r, c in ((a, b, most, price), (b, a, 0, -price)):
            edges[start].append(len(head))
            head.append(end)
            room.append(r)
            cost.append(c)

    for i, p in enumerate(patterns):
        for copy in range(copies):
            edge(0, 2 + i, capacity[p], copy)
        for s in members[p]:
            edge(2 + i, node[s], copies * capacity[p], 0)
    for s in sources:
        edge(node[s], 1, demand[s], 0)
    level = [0] * len(edges)
    while True:
        far: list[float] = [float("inf")] * len(edges)
        came = [-1] * len(edges)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in edges[a]:
                step = d + cost[e] + level[a] - level[head[e]]
                if room[e] and step < far[head[e]]:
                    far[head[e]], came[head[e]] = step, e
                    heapq.heappush(heap, (step, head[e]))
        if came[1] < 0:
            break
        level = [int(x + min(f, far[1])) for x, f in zip(level, far, strict=True)]
        path, at = [], 1
        while at:
            path.append(came[at])
            at = head[came[at] ^ 1]
        words = min(room[e] for e in path)
        for e in path:
            room[e] -= words
            room[e ^ 1] += words
    given = [0] * len(edges)
    for e in edges[0]:
        given[head[e]] += room[e ^ 1]
    return given[2 : 2 + len(patterns)]


def mixed(
    docs: DataFrame,
    sources: str,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    copies: int = MOST_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, text_key, size, sources, source_size, target, taken)`` of each row of ``docs``.

    ``sources`` is an array column of names, null among them counting as one more name; an empty or
    null array is a pattern of no source, of which nothing is taken. Names by code point, null last,
    weigh ``weights`` in turn. ``size`` counts words (0 for a null text). ``source_size`` and
    ``target`` are sums over the document's sources. ``taken`` is the document's size times the
    number of its copies in the mix; a pattern's documents come whole, in the order of their seeded
    digests (of the id, of the text where that is null), up to the one that brings their sum nearest to the flow. Rows alike in id and text
    are equal in that order. No rows, no result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    names = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array().cast("array<string>"))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), text_key("text").cast("string")))
    digest = F.md5(F.concat_ws("/", F.lit(seed), name))
    sized = stored(
        docs.select("doc_id", text_key("text").alias("text_key"), size.alias("size"), names.alias("sources"), digest.alias("digest"))
    )
    patterns = [(list(r.sources), r.size) for r in sized.groupBy("sources").agg(F.sum("size").alias("size")).collect()]
    patterns.sort(key=lambda p: [(n is None, (n or "").encode()) for n in p[0]])
    order = sorted({n for p, _ in patterns for n in p}, key=lambda n: (n is None, (n or "").encode()))
    number = {n: i for i, n in enumerate(order)}
    source_size = [0] * len(order)
    for members, words in patterns:
        for n in members:
            source_size[number[n]] += words
    target = targets(source_size, [weights[i % len(weights)] for i in range(len(order))], share, copies) if order else []
    real = [i for i, (members, _) in enumerate(patterns) if members]
    flow = route(
        [patterns[i][1] for i in real],
        [[number[n] for n in patterns[i][0]] for i in real],
        [int(t) for t in target],
        copies,
    )
    words = dict(zip(real, flow, strict=True))
    rows = []
    for i, (members, total) in enumerate(patterns):
        whole, rest = divmod(words.get(i, 0), total) if total else (0, 0)
        mine = [number[n] for n in members]
        rows.append((members, sum(source_size[s] for s in mine), float(sum(target[s] for s in mine)), whole, rest))
    plan = sized.sparkSession.createDataFrame(
        rows, "sources array<string>, source_size bigint, target double, whole bigint, rest bigint"
    )

    # where in the seeded order the rest of each pattern ends: a bin first, then a place in the bin
    bin_of = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    if len(rows) <= LISTED:
        plan = F.broadcast(plan)
    planned = sized.withColumn("bin", bin_of)
    bins = planned.groupBy("sources", "bin").agg(F.sum("size").alias("in_bin"))
    upto = Window.partitionBy("sources").orderBy("bin")
    ends = bins.withColumn("through", F.sum("in_bin").over(upto)).join(plan, "sources")
    ends = ends.where("through - in_bin < rest and rest <= through").select(
        "sources", F.col("bin").alias("last_bin"), (F.col("rest") - F.col("through") + F.col("in_bin")).alias("rest_in_bin")
    )
    if len(rows) <= LISTED:
        ends = F.broadcast(ends)
    dealt = planned.join(plan, "sources").join(ends, "sources", "left")
    last = F.col("bin") == F.col("last_bin")
    place = Window.partitionBy("sources").orderBy("digest", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.where(last).withColumn("through", F.sum("size").over(place))
    before = F.col("through") - F.col("size")
    chosen = (before < F.col("rest_in_bin")) & (F.col("through") - F.col("rest_in_bin") <= F.col("rest_in_bin") - before)
    inside = inside.withColumn("more", F.when((F.col("through") <= F.col("rest_in_bin")) | chosen, 1).otherwise(0)).drop("through")
    outside = dealt.where(~F.coalesce(last, F.lit(False))).withColumn("more", F.when(F.col("bin") < F.col("last_bin"), 1).otherwise(0))
    taken = F.col("size") * (F.col("whole") + F.col("more"))
    return inside.unionByName(outside).select(
        "doc_id", "text_key", "size", "sources", "source_size", "target", taken.alias("taken")
    )
