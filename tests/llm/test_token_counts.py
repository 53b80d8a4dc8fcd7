import random

import public_tokenizers
import pytest
from conftest import prose

from billfold.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["word", " other", "'re", "'r", " 12", "\n\n", "   ", "\t", "é漢", "!?", "<|endoftext|>", "<|end", "\U0001f600", "a" * 30, " "]


def whole(text):
    return len(T.load(PATH).encode(text or "", add_special_tokens=False).ids)


def found(docs, **sizes):
    out = T.token_counts(docs, PATH, **sizes)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted(map(tuple, out.collect()), key=str)


def want(rows):
    return sorted(((d, len((t or "").encode()), n, n > 512) for d, t in rows for n in [whole(t)]), key=str)


def test_spliced_counts_are_those_of_whole_texts(docs_of):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(400)))) for i in range(60)]
    for chunk, overlap in ((64, 20), (33, 16), (200, 40)):
        assert found(docs_of(rows), chunk=chunk, overlap=overlap) == want(rows)


def test_overlaps_are_widened_where_nothing_aligns(docs_of):
    rows = [(1, "a" * 700 + " b c " + "d" * 300), (2, " " * 900), (3, "ab" * 500 + "<|endoftext|>" * 30), (4, "x" * 129), (5, "1" * 64 + " z" * 500)]
    assert found(docs_of(rows), chunk=64, overlap=16) == want(rows)


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] != 11] + [(11, "x" * 30_000)]
    assert found(docs_of(rows), chunk=4096, overlap=64) == want(rows)
    assert found(docs_of([])) == []


def test_production_sizes(docs_of):
    rows = [(1, prose(1, 40_000)), (1, prose(1, 40_000)), (2, prose(2, 10))]
    assert found(docs_of(rows)) == want(rows)


def test_tokenizers_that_cannot_be_spliced_are_refused(docs_of):
    with pytest.raises(ValueError):
        T.token_counts(docs_of({1: "a"}), public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        T.token_counts(docs_of({1: "a"}), PATH, chunk=10, overlap=5)
