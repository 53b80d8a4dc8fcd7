import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from billfold.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ é\t\n\x0b\x1c漢", max_size=30)), max_size=8)


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_equal_words_and_only_they_share_a_hash(texts):
    hashes, bounds = W.words_of(pa.array(texts, pa.string()))
    words = [plain(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_segments_do_not_change_hashes(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("ab" * rng.randrange(1, 40) for _ in range(rng.randrange(60))) for _ in range(20)] + ["c" * 500, "", "d"]
    column = pa.array(texts)
    whole = W.words_of(column)
    monkeypatch.setattr(W, "SEGMENT", 64)
    cut = W.words_of(column)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_sliced_and_large_columns_read_alike():
    texts = ["a b", None, "C", "d e f"]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        column = pa.array([t and t.encode() for t in texts], pa.binary()).cast(kind)
        hashes, bounds = W.words_of(column.slice(1))
        assert bounds.tolist() == [0, 0, 1, 4]
        assert (hashes == W.words_of(pa.array(["c d e f"]))[0]).all()


def test_shingles_keep_rows_apart_and_short_rows_whole():
    hashes, bounds = W.words_of(pa.array(["a b c d e", "", "b c", "a b c d", "a b c d"]))
    out, at = W.shingles(hashes, bounds, 4)
    assert np.diff(at).tolist() == [2, 0, 1, 1, 1]
    assert out[0] == out[3] == out[4] and len(set(out.tolist())) == 3


def test_row_groups_cover_all_rows():
    column = pa.array(["a" * n for n in (5, 50, 0, 1, 1, 1)])
    assert list(W.row_groups(column, 10)) == [(0, 1), (1, 2), (2, 6)]
    assert list(W.row_groups(column, 100, 4)) == [(0, 4), (4, 6)]
    assert list(W.row_groups(pa.array([], pa.string()))) == []
