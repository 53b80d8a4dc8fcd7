"""A word bigram model by deleted interpolation, and the texts' log probabilities under it.

The maximum-likelihood estimates of a word after the one before, of a word alone, and an even
share are mixed. The weights depend on how often the word before was seen, in buckets of
doubling counts; expectation-maximisation finds them on a held-out share of the training texts
with the counts of the rest. Then all training texts are counted.

Counts never leave their place in the shuffle: texts are dealt into blocks of bounded size; a
block sends its distinct n-grams, as sorted 64-bit hashes cut by their high bits into buckets; a
bucket adds up what all blocks sent and answers each block in the order of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import stored, text_key

BLOCK_BYTES = 2 << 20  # text of a block, on the average
BUCKET_BYTES = 4 << 20  # text whose n-grams a bucket gets, on the average
CONTEXT_BUCKETS = 24
ROUNDS = 12
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_TEST, _KEPT, _HELD = 0, 1, 2


def grams(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens and of all pairs with the token before, and the bounds of each text's tokens.

    A token is a word, or the one end of a text. Even keys are tokens, odd ones pairs.
    """
    words, bounds = W.words_of(column)
    rows = len(bounds) - 1
    bounds = bounds + np.arange(rows + 1)
    tokens = np.full(len(words) + rows, _END)
    inside = np.ones(len(tokens), bool)
    inside[bounds[1:] - 1] = False
    tokens[inside] = words
    before = np.concatenate([[_START], tokens[:-1]]).astype(np.uint64)
    before[bounds[:-1]] = _START
    return W.mix(tokens, 1) & ~np.uint64(1), W.mix(W.mix(before, 2) + tokens, 3) | np.uint64(1), bounds


def pack(sorted_keys: np.ndarray) -> bytes:
    """Differences byte by byte, the high bytes together, which shuffle compression shortens well."""
    return np.ascontiguousarray(np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(planes).view(np.uint64).ravel().astype(np.int64)


def _ask(block: pa.Table, bits: int) -> pa.Table:
    token, pair, bounds = grams(block["text"])
    role = np.repeat(block["role"].to_numpy(), np.diff(bounds))
    keys, number = np.unique(np.concatenate([token, pair]), return_inverse=True)
    del token, pair
    sums = [np.bincount(number, np.tile(role == r, 2), len(keys)).astype(np.int64) for r in (_KEPT, _HELD)]
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    cut = [*np.searchsorted(keys, edges), len(keys)]
    parts = [(b, slice(cut[b], cut[b + 1])) for b in range(1 << bits) if cut[b] < cut[b + 1]]
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in parts], pa.int64()),
            "block": pa.array([block["block"][0].as_py()] * len(parts), pa.int64()),
            "keys": pa.array([pack(keys[s]) for _, s in parts], pa.binary()),
            "kept": pa.array([pack_counts(sums[0][s]) for _, s in parts], pa.binary()),
            "held": pa.array([pack_counts(sums[1][s]) for _, s in parts], pa.binary()),
        }
    )


def _answer(asked: pa.Table, blocks: int) -> pa.Table:
    """What a bucket adds up, for each block that asked; with block -1, its distinct and all tokens of training."""
    asked = asked.combine_chunks()
    keys = [unpack(x.as_py()) for x in asked["keys"]]
    every, number = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for column in ("kept", "held"):
        counts = np.concatenate([unpack_counts(x.as_py()) for x in asked[column]])
        sums.append(np.bincount(number, counts, len(every)).astype(np.int64))
    both = sums[0] + sums[1]
    is_token = every % np.uint64(2) == 0
    ends = np.cumsum([len(k) for k in keys])
    mine = [number[e - len(k) : e] for k, e in zip(keys, ends, strict=True)]
    of = asked["block"].to_pylist()
    return pa.table(
        {
            "block": pa.array([-1, *of], pa.int64()),
            "bucket": pa.array([asked["bucket"][0].as_py()] * (len(of) + 1), pa.int64()),
            "total": pa.array([None, *(pack_counts(both[m]) for m in mine)], pa.binary()),
            "kept": pa.array([None, *(pack_counts(sums[0][m]) if b >= blocks else None for b, m in zip(of, mine, strict=True))], pa.binary()),
            "n": pa.array([int(both[is_token].sum()), *[None] * len(of)], pa.int64()),
            "n_kept": pa.array([int(sums[0][is_token].sum()), *[None] * len(of)], pa.int64()),
            "v": pa.array([int((both[is_token] > 0).sum()), *[None] * len(of)], pa.int64()),
        }
    )


_ANSWERED = "block bigint, bucket bigint, total binary, kept binary, n bigint, n_kept bigint, v bigint"


class Estimates:
    """Counts of a block's tokens, and the estimates that are mixed."""

    def __init__(self, block: pa.Table, answers: pa.Table, column: str, n: int, v: int, texts: int):
        token, pair, self.bounds = grams(block["text"])
        keys, number = np.unique(np.concatenate([token, pair]), return_inverse=True)
        del keys
        order = np.argsort(answers["bucket"].to_numpy())
        parts = answers[column].to_pylist()
        counts = np.concatenate([unpack_counts(parts[i]) for i in order])[number]
        self.count, pairs = counts[: len(token)], counts[len(token) :]
        seen = np.concatenate([[0], self.count[:-1]])
        seen[self.bounds[:-1]] = texts
        self.bucket = np.where(seen > 0, np.minimum(np.log2(np.maximum(seen, 1)).astype(int) + 1, CONTEXT_BUCKETS - 1), 0)
        self.p = np.stack([pairs / np.maximum(seen, 1), self.count / max(n, 1), np.full(len(token), 1 / (v + 1))])


def learned_weights(examples: DataFrame, even: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the estimates for each context bucket, by expectation-maximisation; one small job a round.

    Each weight starts, and is kept from zero, as if a token of each estimate had been seen. A
    bucket without examples mixes evenly.
    """
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    for _ in range(rounds):

        def share(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((CONTEXT_BUCKETS, 3))
            for batch in batches:
                for bucket, pair, alone in zip(*(batch[c].to_pylist() for c in ("bucket", "pair", "alone")), strict=True):
                    b = np.frombuffer(bucket, np.uint8)
                    p = np.stack([np.frombuffer(pair, np.float32), np.frombuffer(alone, np.float32), np.full(len(b), even)])
                    mixed = weights[b].T * p
                    mixed /= mixed.sum(axis=0)
                    sums += np.stack([np.bincount(b, m, CONTEXT_BUCKETS) for m in mixed], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        parts = [np.frombuffer(r.sums).reshape(CONTEXT_BUCKETS, 3) for r in examples.mapInArrow(share, "sums binary").collect()]
        total = sum(parts, np.zeros((CONTEXT_BUCKETS, 3))) + 1.0
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def scored(
    docs: DataFrame,
    learns: Column,
    holds: Column,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs(doc_id, text)``.

    Rows where ``learns`` holds are the training texts (null: not), and those of them where
    ``holds`` holds are held out for the weights. ``base_score`` is the unigram model with half a
    count added, ``score`` the interpolated model, both log10 of the whole text's probability; a
    null text is empty and has its end only. Nothing learned: all tokens are unknown and count even.
    Repeated rows are learned and scored each. Other columns are not looked at. What the driver
    gets is a few numbers per bucket of the context counts and per table, never n-grams.
    """
    role = F.when(F.coalesce(learns, F.lit(False)), F.when(F.coalesce(holds, F.lit(False)), _HELD).otherwise(_KEPT)).otherwise(_TEST)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), role.cast("int").alias("role"), text_key("text").alias("k"))
    size, texts, kept_texts = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(F.col("role") != _TEST, 1)), F.count(F.when(F.col("role") == _KEPT, 1))
    ).first()
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, int(-(-size // bucket_bytes) - 1).bit_length()) if size else 0
    block = F.pmod(F.xxhash64("doc_id", "k"), F.lit(blocks)) + F.when(F.col("role") == _HELD, blocks).otherwise(0)
    dealt = rows.select("doc_id", "text", "role", block.alias("block"))

    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask(t, bits), "bucket bigint, block bigint, keys binary, kept binary, held binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, blocks), _ANSWERED))
    sums = answers.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_kept", "v"))).first()
    n, n_kept, v = (int(x) for x in sums)
    answers = answers.where("block >= 0").select("block", "bucket", "total", "kept")

    def example(text: pa.Table, found: pa.Table) -> pa.Table:
        if not text.num_rows:
            return pa.table({c: pa.array([], pa.binary()) for c in ("bucket", "pair", "alone")})
        e = Estimates(text, found, "kept", n_kept, v, kept_texts)
        values = (e.bucket.astype(np.uint8), e.p[0].astype(np.float32), e.p[1].astype(np.float32))
        return pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("bucket", "pair", "alone"), values, strict=True)})

    held, held_answers = dealt.where(F.col("role") == _HELD), answers.where(F.col("block") >= blocks)
    examples = held.groupBy("block").cogroup(held_answers.groupBy("block")).applyInArrow(example, "bucket binary, pair binary, alone binary")
    weights = learned_weights(stored(examples), 1 / (v + 1))

    def score(text: pa.Table, found: pa.Table) -> pa.Table:
        names = ("doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        if not text.num_rows:
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds, strict=True)})
        e = Estimates(text, found, "total", n, v, texts)
        base = np.log10((e.count + 0.5) / (n + 0.5 * (v + 1)))
        model = np.log10(np.einsum("ij,ji->i", weights[e.bucket], e.p))
        at = e.bounds[:-1]
        columns = (
            text["doc_id"], pa.array(text["role"].to_numpy() != _TEST), pa.array(np.diff(e.bounds)),
            pa.array(np.add.reduceat((e.count > 0).astype(np.int64), at)), pa.array(np.full(len(at), n)),
            pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(model, at)),
        )
        return pa.table(dict(zip(names, columns, strict=True)))

    schema = "doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
