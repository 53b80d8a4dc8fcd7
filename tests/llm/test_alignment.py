import hashlib
import json
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import prose

from billfold.llm import alignment
from billfold.llm.alignment import EndIndex, aligned, aligner, links, pair_counts

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def byte_of_symbol():
    """GPT-2's table, as published: printable bytes as they are, the rest from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, libraries):
    """Every pair of token occurrences of a text compared, as whole-library encodings give them."""
    a_lib, b_lib = libraries
    symbols = byte_of_symbol()
    texts = []
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        spans = []
        for ids, piece in ((a, lambda i: bytes(symbols[c] for c in a_lib.id_to_token(i))), (b, lambda i: b_piece(b_lib, i))):
            at, out, joined = 0, [], b""
            for i in ids:
                joined += piece(i)
                out.append((at, len(joined), i))
                at = len(joined)
            spans.append(out)
            if text and joined != (" " + text).encode():
                spans = [[], []]
                break
        texts.append((doc_id, *spans))
    pairs, per_text = Counter(), []
    for doc_id, a, b in texts:
        linked = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        pairs.update(linked)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, before = [], 0
        for e in ends:
            groups.append(",".join(str(x[2]) for x in a if before < x[1] <= e) + "|" + ",".join(str(y[2]) for y in b if before < y[1] <= e))
            before = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        per_text.append((doc_id, len(a), len(b), len(ends), linked, digest))
    highest = Counter()
    for (_, b), n in pairs.items():
        highest[b] = max(highest[b], n)
    return Counter(
        (i, n_a, n_b, n_g, len(ls), sum(pairs[p] == highest[p[1]] for p in ls), sum(pairs[p] for p in ls), digest)
        for i, n_a, n_b, n_g, ls, digest in per_text
    ), pairs


def b_piece(b_lib, i):
    piece = b_lib.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()


def found(df):
    return Counter(tuple(r) for r in df.collect())


WORDS = ["Überraschung", "naïve", "l'été", "don't", "  ", "\n\n", "<|endoftext|>", "<s>", "漢字", "\U0001f600", "é", "12345", "antidisestablishment", "x" * 30]


def test_against_brute_force(docs_of, libraries):
    rows = [(i, prose(i, 40, 30) + " " + " ".join(WORDS[i % 7 : i % 7 + 5])) for i in range(30)] + [(100 + i, "the same words again " * 5) for i in range(30)]
    want, pairs = brute(rows, libraries)
    docs = docs_of(rows).repartition(5)
    assert found(aligned(docs, A_PATH, B_PATH)) == want
    assert found(aligned(docs, A_PATH, B_PATH, block=300)) == want
    assert {(r.a_id, r.b_id): r.n for r in pair_counts(docs, A_PATH, B_PATH).collect()} == pairs


def test_odd_rows(docs_of, odd_rows, libraries):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + [(20, "piece ▁ mark"), (21, " "), (22, "▁"), (23, "a\x00b"), (23, "a\x00b")]
    out = found(aligned(docs_of(rows), A_PATH, B_PATH))
    assert out == brute(rows, libraries)[0]
    assert out[20, 0, 0, 0, 0, 0, 0, ""] == 1 and out[1, 0, 0, 0, 0, 0, 0, ""] == 1  # the mark reads as a space: bytes differ
    long = [r for r in odd_rows if len(r[1] or "") >= 10_000]
    for r in aligned(docs_of(long), A_PATH, B_PATH).collect():
        text = dict(long)[r.doc_id]
        assert r.n_a == len(libraries[0].encode(" " + text, add_special_tokens=False).ids) and r.n_b == len(libraries[1].encode(text))
        assert r.n_links == r.n_a + r.n_b - r.n_groups


def test_quick_ids_are_the_librarys(libraries):
    a = aligner(A_PATH, B_PATH).a
    assert a.quick and json.loads(open(A_PATH, encoding="utf-8").read())["model"]["type"] == "BPE"
    points = [*range(0x250), *range(0x2000, 0x2070)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}? {chr(c)}a  {chr(c)}\n{chr(c)}{chr(c)}1 <|endoftext|>" for c in points]
    texts += [prose(i, 200) for i in range(5)] + [" " * 30_000, "\n " * 9000, "ab" * 20_000, "!?" * 9000]
    for t in texts:
        assert alignment._STABLE.fullmatch(t) and a.encode(t).tolist() == libraries[0].encode(t, add_special_tokens=False).ids
    assert not alignment._STABLE.fullmatch("漢") and not alignment._STABLE.fullmatch("ɐ")


def test_common_ends_and_links():
    rng = np.random.default_rng(2)
    for _ in range(50):
        size = int(rng.integers(1, 60))
        a, b = (np.union1d(rng.integers(1, size + 1, 20), [size]) for _ in range(2))
        index_a, index_b = EndIndex(a, size), EndIndex(b, size)
        common = index_a.common(index_b)
        assert common.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert (a[index_a.number[common] - 1] == common).all() and (b[index_b.number[common] - 1] == common).all()
        starts = [dict(zip(range(len(e)), [0, *e[:-1]], strict=True)) for e in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert sorted(zip(*(x.tolist() for x in links(a, b, index_a.either(index_b))), strict=True)) == want


def test_no_rows(docs_of):
    assert found(aligned(docs_of([]), A_PATH, B_PATH)) == Counter()
    assert found(aligned(docs_of([(1, None), (2, "")]), A_PATH, B_PATH)) == Counter({(i, 0, 0, 0, 0, 0, 0, ""): 1 for i in (1, 2)})
