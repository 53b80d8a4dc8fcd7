import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest import prose

from billfold.llm import spelling
from billfold.llm.spelling import Acceptor, near_words, spelling_variants, vocabulary

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows):
    """Every occurrence on its own."""
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def is_near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    n = brute_words(rows)
    near = {w: [] for w in n}
    for x, y in combinations(n, 2):
        if is_near(x, y):
            near[x].append(y)
            near[y].append(x)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def strings(rng, n, longest, letters="ab\xe9"):
    return sorted({"".join(rng.choices(letters, k=rng.randrange(longest))) for _ in range(n)})


def test_acceptor_is_minimal_and_numbers_its_strings():
    rng = random.Random(3)
    for _ in range(50):
        words = strings(rng, 40, 7)
        a = Acceptor()
        start = a.add(words)
        assert a.add(words) == start
        listed, waiting = {}, [(start, 0, "")]
        while waiting:
            s, i, w = waiting.pop()
            if a.final[s]:
                listed[w] = i
            waiting.extend((to, i + n, w + c) for c, (to, n) in a.arcs[s].items())
        assert listed == {w: i for i, w in enumerate(words)}
        prefixes = {w[:k] for w in words for k in range(len(w) + 1)} | {""}
        rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
        assert len(a.final) == len(rights)  # one state for each set of continuations


@pytest.mark.parametrize("deep", [200, 2])
def test_compositions_give_each_pair_once(monkeypatch, deep):
    monkeypatch.setattr(spelling, "_DEEP", deep)
    rng = random.Random(5)
    a = Acceptor()
    for _ in range(100):
        words = strings(rng, 30, 6)
        got = [frozenset((words[i], words[j])) for i, j in a.replaced(a.add(words))]
        want = {frozenset(p) for p in combinations(words, 2) if len(p[0]) == len(p[1]) and is_near(*p)}
        assert len(got) == len(set(got)) and set(got) == want
        size = rng.randrange(1, 5)
        short, long = [w for w in words if len(w) == size], [w for w in words if len(w) == size + 1]
        pairs = [(long[i], short[j]) for i, j in a.inserted(a.add(long), a.add(short))]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, y) for x in long for y in short if is_near(x, y)}


def test_checksums_of_arrays():
    for prefix, word in ((b"17:", b"abc"), (b":", b"x"), (b"-3:", "\xe9t\xe9".encode() * 9)):
        after = spelling._after(np.array([zlib.crc32(prefix)], np.uint32))[0, len(word)]
        back = len(word) - 1 - np.arange(len(word))
        own = np.bitwise_xor.reduce(spelling._CRC[back, np.frombuffer(word, np.uint8)])
        assert after ^ own == zlib.crc32(prefix + word)


def test_against_brute_force(docs_of):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcde\xe9\xdf", k=rng.randrange(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "the-word"]

    def typed(word):
        at, c = rng.randrange(len(word)), rng.choice("abz")
        return rng.choice([word, word, word.upper(), word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]])

    weights = [1 / (i + 1) for i in range(len(base))]
    rows = [(i, " ".join(typed(w) for w in rng.choices(base, weights, k=rng.randrange(200)))) for i in range(60)]
    rows += [(500 + i, "commonest " * 300) for i in range(40)]  # one word has most of all occurrences
    rows += [(600 + i, f"kettaa {'kettab ' * 3} {'kettbb ' * 9} {'kettbbb ' * 30}") for i in range(9)]  # forms of forms
    want = brute(rows)
    assert len(want) > 100 and any(r[1] and r[1] != r[2] for r in want)
    assert found(spelling_variants(docs_of(rows).repartition(5))) == want


def test_small_blocks_and_early_hand_over(docs_of, monkeypatch):
    rows = [(i, prose(i, 300, 30).replace("w", "worte") + " \xc9t\xe9s\xd7 " * 3) for i in range(20)] + [(77, "nur-Buchstaben" * 500)]
    docs = docs_of(rows)
    data = [(f"{t}中" * 3) for _, t in rows]
    whole = "".join(data).encode()
    starts = np.cumsum([0, *(len(t.encode()) for t in data)])
    monkeypatch.setattr(spelling, "BLOCK", 1000)
    parts, counts = [], {}
    for begin, stop, part in spelling._segments(np.frombuffer(whole, np.uint8), starts):
        parts.append(whole[begin:stop])
        row_starts = np.clip(starts[part.start : part.stop + 1], begin, stop) - begin
        prefixes = [b"%d:" % i for i in range(len(data))][part]
        spelling._count(np.frombuffer(parts[-1], np.uint8), row_starts, prefixes, counts)
    assert b"".join(parts) == whole
    want = brute_words(enumerate(data))
    assert {w: n for w, n in counts.items() if n >= 3} == want
    assert {r.word: r.n for r in vocabulary(docs).collect()} == brute_words(rows)


def test_odd_rows(docs_of, odd_rows, spark):
    long = "y" * 70_000
    rows = [*odd_rows, *((20 + i, f"{long} {long}z \xd7\xf7\xd7\xf7\xd7 ABCDEİ abcdſ") for i in range(3))]
    want = brute(rows)
    out = found(spelling_variants(docs_of(rows)))
    assert out == want and {r[0] for r in out} >= {long, long + "z", "\xd7\xf7\xd7\xf7\xd7", "abcde"}
    chain = spark.createDataFrame([("aaaaa", 4), ("aaaab", 4), ("aaabb", 4), ("bbbbb", 1)], "word string, n bigint")
    assert {tuple(r) for r in near_words(chain).collect()} == {("aaaaa", 1, 4, "aaaab"), ("aaaab", 2, 4, "aaaaa"), ("aaabb", 1, 4, "aaaab")}


def test_no_rows(docs_of):
    assert found(spelling_variants(docs_of([]))) == set()
    assert found(spelling_variants(docs_of([(1, None), (2, "")]))) == set()
