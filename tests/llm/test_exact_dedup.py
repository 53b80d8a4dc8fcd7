import hashlib
import random
from collections import Counter, defaultdict

import pytest
from conftest import prose

from billfold.llm.exact_dedup import Trie, exact_duplicates


def brute(rows, largest=True):
    """The result written out with a dictionary of whole texts."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = (max(named) if largest else min(named)) if named else None
        stays = ids.index(keep)
        for place, doc_id in enumerate(ids):
            out[doc_id, keep, len(ids), place == stays, hashlib.sha256(text).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_trie_against_a_dictionary():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(9))) for _ in range(3000)] + [b"x" * 5000, b"x" * 4999, b"x" * 4999 + b"y"]
    trie, counts = Trie(), Counter(texts)
    for t in texts:
        end = trie.terminal(t)
        end.owner = (end.owner or 0) + 1
    taken = []
    while trie.sizes:
        taken.extend(trie.spill())
    assert trie.held == 0
    taken.extend(trie.rest())
    assert len(taken) == len(counts) and dict(taken) == counts


def test_edges_are_compressed():
    trie = Trie()
    for t in (b"same beginning one", b"same beginning two", b"same"):
        trie.terminal(t).owner = 1
    (top,) = trie.root.children.values()
    assert top.label == b"same" and [c.label for c in top.children.values()] == [b" beginning "]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [32 << 20, 2000])
def test_against_brute_force(docs_of, keep, budget):
    rng = random.Random(11)
    base = [prose(s, rng.randrange(1, 40)) for s in range(60)]
    rows = [(i, t) for i, t in enumerate(rng.choices(base, k=300))]
    rows += [(1000 + i, base[0].upper() if i % 2 else base[0]) for i in range(200)]  # a third of all rows
    rows += [(2000, base[1] + " "), (2001, base[2][:-1]), (2002, "É"), (2003, "é")]
    rng.shuffle(rows)
    docs = docs_of(rows).repartition(7)
    assert found(exact_duplicates(docs, keep, budget)) == brute(rows, keep == "largest")


def test_odd_rows(docs_of, odd_rows):
    rows = [*odd_rows, (None, None), (None, "only without id"), (None, "ONLY without id")]
    out = found(exact_duplicates(docs_of(rows).repartition(3), "largest"))
    assert out == brute(rows)
    # (5, x) given twice is three rows with the null id: one stays; empty and null texts are one group
    assert out[5, 5, 3, True, brute([(5, prose(2, 80))]).most_common(1)[0][0][4]] == 1
    assert sum(n for (_, keep, size, _, _), n in out.items() if (keep, size) == (2, 4)) == 4


def test_no_rows(docs_of):
    assert found(exact_duplicates(docs_of([]))) == Counter()
    with pytest.raises(ValueError):
        exact_duplicates(docs_of([]), "first")
