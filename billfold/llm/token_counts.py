"""Token counts of whole texts, huge ones encoded in overlapping chunks and spliced.

A byte-level tokenizer cuts a text into pieces from left to right and looks at nothing before the
place it has reached, so two encodings that both begin a piece at the same character agree from
there on. Chunk encodings are therefore spliced at a place where the left one, right from the
text's beginning by induction, and the right one both begin a piece, and which lies so far
before the left chunk's end that nothing behind the end can move it. Where the overlap of two chunks
holds no such place, it is widened to the whole of both, and they are encoded as one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import stored

CHUNK = 1 << 16  # characters of a chunk without its overlaps
OVERLAP = 512
LIMIT = 512
_BATCH = 1 << 20  # characters handed to the tokenizer at once


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def margin(path: str) -> int:
    """Characters after a place that its beginning a piece can depend on: those of a special token, or of `` 're``."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    cutter = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("chunks can be spliced for a byte-level tokenizer without normalizer and prefix space only")
    added = spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours cannot be spliced")
    return max([4, *(len(t["content"]) for t in added)])


def piece_starts(encoding) -> dict[int, int]:
    """Characters at which a piece begins, with the number of tokens before each."""
    out, before, ended = {}, None, 0
    for i, (word, (start, end)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != before and ended == start:
            out[start] = i
        before, ended = word, end
    return out


_CHUNKS = "uid string, doc_id bigint, n_bytes bigint, piece int, last boolean, start bigint, core bigint, core_end bigint, text string"


def _split(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Small texts with their counts, and the chunks of the others."""
    names = ["doc_id", "n_bytes", "n_tokens", "uid", "piece", "last", "start", "core", "core_end", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in W.sliced(batches, "text"):
            waiting: list[tuple[int | None, int, str]] = []
            size = 0

            def counted(waiting=waiting) -> pa.RecordBatch:
                found = tokenizer.encode_batch_fast([t for _, _, t in waiting], add_special_tokens=False)
                out = batch_of([(i, n, len(e), *[None] * 7) for (i, n, _), e in zip(waiting, found, strict=True)])
                waiting.clear()
                return out

            for doc_id, n_bytes, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "text")), strict=True):
                if len(text) <= chunk:
                    waiting.append((doc_id, n_bytes, text))
                    size += len(text)
                    if size >= _BATCH or len(waiting) >= 1000:
                        yield counted()
                        size = 0
                    continue
                uid, pieces = uuid.uuid4().hex, -(-len(text) // chunk)
                for p in range(pieces):
                    core, end = p * chunk, min(len(text), (p + 1) * chunk)
                    start = max(0, core - overlap)
                    yield batch_of([(doc_id, n_bytes, None, uid, p, p == pieces - 1, start, core, end, text[start : end + overlap])])
            if waiting:
                yield counted()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, " + _CHUNKS.replace("doc_id bigint, n_bytes bigint, ", "")
    return rows.mapInArrow(run, schema)


def _encoded(chunks: DataFrame, path: str, safe: int) -> DataFrame:
    """Of each chunk its tokens and the piece starts in its overlaps; those on the right proven."""
    names = ["uid", "doc_id", "n_bytes", "piece", "last", "n", "left", "right"]
    table = pa.map_(pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                text, start = row["text"], row["start"]
                encoding = tokenizer.encode(text, add_special_tokens=False)
                places = {start + c: t for c, t in piece_starts(encoding).items()}
                overlap, end = row["core"] - start, start + len(text)
                reach = max(overlap, end - row["core_end"])
                left = {c: t for c, t in places.items() if c <= row["core"] + reach}
                right = {c: t for c, t in places.items() if c >= row["core_end"] - reach and c + safe <= end}
                values = [row["uid"], row["doc_id"], row["n_bytes"], row["piece"], row["last"], len(encoding.ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()), strict=True)),
                        pa.array([list(left.items())], table),
                        pa.array([list(right.items())], table),
                    ],
                    names,
                )

    schema = "uid string, doc_id bigint, n_bytes bigint, piece int, last boolean, n bigint, left map<bigint,bigint>, right map<bigint,bigint>"
    return chunks.repartition("uid", "piece").mapInArrow(run, schema)


def _merged(rows):
    """The chunks of one run as one chunk."""
    rows = rows.sort_values("piece")
    first, last = rows.iloc[0], rows.iloc[-1]
    if len(rows) > 1:
        head = first["text"][: first["core_end"] - first["start"]]
        inner = [r["text"][r["core"] - r["start"] : r["core_end"] - r["start"]] for _, r in rows.iloc[1:-1].iterrows()]
        out = rows.iloc[:1].assign(
            text=head + "".join(inner) + last["text"][last["core"] - last["start"] :], core_end=last["core_end"], last=last["last"]
        )
    else:
        out = rows
    return out[["uid", "doc_id", "n_bytes", "piece", "last", "start", "core", "core_end", "text"]]


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs(doc_id, text)``.

    Counts are those of the whole text by the tokenizer file at ``path``, without added special
    tokens; a null text counts as empty. Texts of up to ``chunk`` characters are encoded whole; the
    chunks of longer ones are dealt out to all tasks. Each round splices what it can; the chunks
    on both sides of a seam without a proven place are merged for the next round, so rounds end at the latest
    when a text is whole. Other columns are not looked at.
    """
    if overlap < 1 or chunk <= 2 * overlap:
        raise ValueError("a chunk must be longer than its two overlaps")
    safe = margin(path)
    split = stored(_split(docs, path, chunk, overlap))
    out = split.where("uid is null").select("doc_id", "n_bytes", "n_tokens")
    chunks = split.where("uid is not null").drop("n_tokens")
    order = Window.partitionBy("uid").orderBy("piece")
    while not chunks.isEmpty():
        encoded = _encoded(chunks, path, safe).withColumn("next", F.lead("left").over(order))
        seam = F.array_max(F.array_intersect(F.map_keys("right"), F.map_keys("next")))
        seamed = encoded.withColumn("seam", seam).withColumn("begin", F.lag("seam").over(order))
        broken = ~F.col("last") & F.col("seam").isNull()
        upto = F.when(F.col("last"), F.col("n")).otherwise(F.element_at("right", F.col("seam")))
        since = F.when(F.col("begin").isNull(), 0).otherwise(F.element_at("left", F.col("begin")))
        spliced = seamed.select(
            "uid", "doc_id", "n_bytes", "piece", (upto - since).alias("tokens"), broken.cast("int").alias("broken"),
            F.coalesce(F.sum((~broken).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run"),
        )
        spliced = stored(spliced)
        whole = spliced.groupBy("uid", "doc_id", "n_bytes").agg(F.sum("tokens").alias("n_tokens"), F.max("broken").alias("broken"))
        out = out.unionByName(whole.where("broken = 0").select("doc_id", "n_bytes", "n_tokens"))
        failed = spliced.join(whole.where("broken = 1").select("uid"), "uid").select("uid", "piece", "run")
        if failed.isEmpty():
            break
        again = chunks.join(failed, ["uid", "piece"])
        chunks = stored(again.groupBy("uid", "run").applyInPandas(_merged, _CHUNKS))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
