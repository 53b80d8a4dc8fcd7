"""Tokens of two tokenizers over the same bytes, matched where both end.

The cumulative byte ends of both encodings of a text are keys of two dictionaries, end to index
(ends are small whole numbers, so a dictionary is an array addressed by them);
the keys they have in common, in order, cut both id lists into groups. Inside a group an A and a B token are
linked where their bytes overlap: every stretch between neighbouring ends of either kind is one
link. How often each pair of ids is linked is counted over the whole corpus: a block of texts
sends each of its pairs once with its count, and gets the corpus counts of these back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import stored

BLOCK = 3 << 20  # bytes of texts whose pairs are sent together
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # how byte-level tokenizers cut
#: Characters whose classes no version of Unicode has changed: here two libraries read the pattern alike.
_STABLE = re.compile("[\x00-\u024f\u2000-\u206f]*")
_FAST = 1 << 20  # characters


def _byte_symbols() -> dict[str, int]:
    """The characters byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE from its .json file: ids of texts, and the bytes of each id.

    The ids are those of the tokenizers library, special strings read as plain text. Where its merges
    are numbered in order, tiktoken finds the same ids from the same vocabulary in a fraction of
    the time; texts with characters that the two may class differently, and very long ones, go
    through the library itself.
    """

    def __init__(self, path: str):
        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cutter, symbols = spec["model"], spec.get("pre_tokenizer") or {}, _byte_symbols()
        vocabulary = {token: bytes(symbols[c] for c in token) for token in model["vocab"]}
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for token, i in model["vocab"].items():
            self.bytes[i] = vocabulary[token]
        merges = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        in_order = all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merges))
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        self.quick = None
        if in_order and plain and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "ignore_merges")):
            import tiktoken

            self.quick = tiktoken.Encoding("byte level", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes)}, special_tokens={})

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        out.encode_special_tokens = True
        return out

    def encode(self, text: str) -> np.ndarray:
        if self.quick and len(text) <= _FAST and _STABLE.fullmatch(text):
            return self.quick.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentencepiece model that puts a space before the text: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Spelling:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def is_of(self, ids: np.ndarray, ends: np.ndarray, text: np.ndarray) -> bool:
        """Whether the ids' bytes, which end there, joined are the text's."""
        if not len(ids) or ends[-1] != len(text):
            return not len(ids) and not len(text)
        sizes = self.sizes[ids]
        moved = (self.starts[ids] - ends + sizes).astype(np.int32)
        return bool((self.data[np.repeat(moved, sizes) + np.arange(len(text), dtype=np.int32)] == text).all())


class EndIndex:
    """The dictionary from a token's end to its number, from 1 on; 0 for what is no end."""

    def __init__(self, ends: np.ndarray, size: int):
        self.number = np.zeros(size + 1, np.int32)
        self.number[ends] = np.arange(1, len(ends) + 1, dtype=np.int32)

    def common(self, other: EndIndex) -> np.ndarray:
        """The keys of both, in order."""
        return np.flatnonzero((self.number > 0) & (other.number > 0))

    def either(self, other: EndIndex) -> np.ndarray:
        return np.flatnonzero(self.number | other.number)


def links(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indices of each A-B pair whose bytes overlap, in order of place: one for each stretch between ``ends`` of either."""
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def _numerals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n-1, right aligned with room for one sign behind, and how many there are."""
    width = len(str(max(n - 1, 0)))
    values = np.arange(n)
    digits = np.stack([values // 10**k % 10 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8) + 48
    count = np.maximum(1, sum((values >= 10**k).astype(np.int64) for k in range(width)))
    return np.concatenate([digits, np.zeros((n, 1), np.uint8)], axis=1), count


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.spell_a, self.spell_b = Spelling(self.a.bytes), Spelling(self.b.bytes)
        self.digits, self.width = _numerals(max(len(self.a.bytes), len(self.b.bytes)))
        self.place = np.arange(self.digits.shape[1])

    def groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, A's before B's."""
        before_a, before_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
        of_a, of_b = np.repeat(np.arange(len(cut_a)), cut_a - before_a), np.repeat(np.arange(len(cut_b)), cut_b - before_b)
        ids = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + cut_a[of_b]
        ids[at_a], ids[at_b] = a, b
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[at_a[cut_a - 1]] = ord("|")
        sign[at_b[cut_b - 1]] = ord(";")
        cells = self.digits[ids]
        cells[:, -1] = sign
        return cells[self.place >= len(self.place) - 1 - self.width[ids][:, None]][:-1].tobytes()

    def __call__(self, text: str, b_ids: list[int]) -> tuple[int, int, int, str, np.ndarray] | None:
        """Tokens of A and B, groups, their digest and the links as ``A id * size of B + B id``; None if the bytes differ."""
        whole = np.frombuffer((" " + text).encode(), np.uint8)
        a, b = self.a.encode(" " + text), np.array(b_ids, np.uint32)
        ends_a, ends_b = np.cumsum(self.spell_a.sizes[a]), np.cumsum(self.spell_b.sizes[b])
        if not (self.spell_a.is_of(a, ends_a, whole) and self.spell_b.is_of(b, ends_b, whole)):
            return None
        index_a, index_b = EndIndex(ends_a, len(whole)), EndIndex(ends_b, len(whole))
        common = index_a.common(index_b)
        cut_a, cut_b = index_a.number[common], index_b.number[common]
        at_a, at_b = links(ends_a, ends_b, index_a.either(index_b))
        digest = hashlib.sha256(self.groups(a, b, cut_a, cut_b)).hexdigest()
        return len(a), len(b), len(common), digest, a[at_a].astype(np.int64) * len(self.b.bytes) + b[at_b]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(a_path, b_path)


def _planes(values: np.ndarray) -> bytes:
    """Small numbers byte by byte, all lowest first: what is nearly always zero lies together and packs well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_DOCS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, places binary"
_BLOCKS = f"block bigint, {_DOCS}, pair bigint, n bigint"
_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_KINDS = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _BLOCKS.split(", ")]
_DOC_ROWS, _PAIR_ROWS = 256, 1 << 16  # handed back to Spark at once


def _batch(rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(_NAMES, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _blocks(docs: DataFrame, a_path: str, b_path: str, block: int) -> DataFrame:
    """Two kinds of rows of each block of texts: its documents, and the distinct pairs of ids linked in it with their counts.

    ``places`` has the places of a document's links among the block's pairs, sorted, as differences.
    """

    def rows(found: list[tuple[int | None, tuple | None]]) -> Iterator[pa.RecordBatch]:
        uid = int.from_bytes(os.urandom(8), "big") >> 1
        aligned = [(i, *(f or (0, 0, 0, "", np.zeros(0, np.int64)))) for i, f in found]
        n_links = np.array([len(f[-1]) for f in aligned], np.int64)
        seen, pairs = pd.factorize(np.concatenate([f[-1] for f in aligned]))
        order = np.argsort(pairs)
        rank = np.empty(len(pairs), np.int32)
        rank[order] = np.arange(len(pairs), dtype=np.int32)
        place, pairs = rank[seen], pairs[order]
        del seen
        n = np.bincount(place, minlength=len(pairs))
        steps = [_planes(np.diff(np.sort(p), prepend=np.int32(0))) for p in np.split(place, np.cumsum(n_links)[:-1])]
        for at in range(0, len(aligned), _DOC_ROWS):
            part = slice(at, at + _DOC_ROWS)
            columns = {c: [f[k] for f in aligned[part]] for k, c in enumerate(("doc_id", "n_a", "n_b", "n_groups", "digest"))}
            size = len(columns["doc_id"])
            yield _batch(size, block=[uid] * size, **columns, n_links=n_links[part], places=steps[part])
        for at in range(0, len(pairs), _PAIR_ROWS):
            part = pairs[at : at + _PAIR_ROWS]
            yield _batch(len(part), block=np.full(len(part), uid), pair=part, n=n[at : at + _PAIR_ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        waiting: list[tuple[int | None, tuple | None]] = []
        size = 0
        for part in W.sliced(batches, "text", size=1 << 18):
            texts = [t or "" for t in part["text"].to_pylist()]
            for doc_id, text, b_ids in zip(part["doc_id"].to_pylist(), texts, align.b.encode(texts), strict=True):
                waiting.append((doc_id, align(text, b_ids) if text else None))
                size += len(text)
                if size >= block:
                    yield from rows(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from rows(waiting)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCKS)


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus counts of its pairs in the pairs' order."""
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string()]
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    order = np.argsort(counts["pair"].to_numpy())
    total, best = counts["total"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)
    places = [np.cumsum(_from_planes(p)) for p in docs["places"].to_pylist()]
    sums = [np.array([values[p].sum() for p in places], np.int64) for values in (best, total)]
    columns = [*(docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, docs["digest"]]
    return pa.table([c.cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def aligned(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for each row of ``docs(doc_id, text)``.

    ``a_path`` is a byte-level .json, which gets a space and the text, ``b_path`` a sentencepiece .model, which
    adds that space. Texts that are null or empty, or whose tokens' joined bytes are not the space and the
    text, have no tokens: zeros and an empty digest. ``count_sum`` adds up, over the document's links,
    how many links of the corpus hold the same ids; ``n_best`` counts its links of which no other A
    id is linked more often with the same B id, ties included. A repeated row counts each
    time. No rows give none. Other columns are not looked at.

    A block's distinct pairs are what is shuffled; the highest counts by B id are at most as many
    as B has ids, and only these are broadcast. Memory: a block's links and one text's tokens.
    """
    found = stored(_blocks(docs, a_path, b_path, block))
    asked = found.where(F.col("pair").isNotNull()).select(F.col("block").alias("asker"), "pair", "n")
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("total")))
    b_id = F.pmod("pair", F.lit(b_size(b_path)))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))
    counts = counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")
    answered = asked.join(counts.select("pair", "total", (F.col("total") == F.col("highest")).alias("best")), "pair").select("asker", "pair", "total", "best")
    rows = found.where(F.col("pair").isNull()).drop("pair", "n")
    return rows.groupBy("block").cogroup(answered.groupBy("asker")).applyInArrow(_summed, _ALIGNED)


def b_size(path: str) -> int:
    """The number of ids of a sentencepiece model."""
    return len(Pieces(path).bytes)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """``(a_id, b_id, n)``: how often each pair of ids is linked in all texts."""
    size = F.lit(b_size(b_path))
    asked = _blocks(docs, a_path, b_path, block).where(F.col("pair").isNotNull())
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.select(F.floor(F.col("pair") / size).alias("a_id"), F.pmod("pair", size).alias("b_id"), "n")

