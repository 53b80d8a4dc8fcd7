"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its byte n-grams (one to three bytes, A-Z as a-z, ASCII beside letters as
blank), hashed to ``DIMS`` places, logarithmic in the counts and of length one. Spherical
k-means gives each language a few centroids; the nearest by cosine decides. A quarter of the sample is
held out of the clustering: what cosines its texts, and pieces of them of any shorter length, have to
their nearest centroid gives the centroid's cut-off at that length, below which a text is rejected.
Under ``SHORTEST`` bytes, and for a language of fewer than four texts, too little is known and the
cut-off is ``REACH`` times the smallest cosine of the centroid's own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import free_names, stored, text_key

DIMS = 4096
PER_LANGUAGE = 500  # labelled texts a language is fitted on at most, those of smallest hash
CENTROIDS = 4
HELD_OUT = 4  # one in so many texts of the sample sets the cut-offs
LOW, SLACK = 0.02, 0.7  # the cut-off: this quantile of the held-out cosines, times this
CLASSES, SHORTEST = 12, 8  # lengths in bytes by powers of two, those from 2,048 as one
LEAST_HELD = 20  # pieces a centroid needs for a cut-off of its own, else its language's
REACH = 0.1  # of the smallest cosine among a centroid's own texts
UNKNOWN = "und"
LISTED = 10_000  # languages whose shares are broadcast at most
SEGMENT = 1 << 20  # bytes whose n-grams are counted at once
_ROUNDS = 12

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    idf: np.ndarray
    labels: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, of each centroid and class of length


def counts(texts: pa.Array, segment: int = SEGMENT) -> np.ndarray:
    """How often each hashed n-gram occurs, a row for each text; so many bytes are worked on at once."""
    data, starts = W.text_bytes(texts)
    rows = len(starts) - 1
    out = np.zeros((rows, DIMS), np.int64)
    for begin in range(0, len(data), segment):
        size = min(segment, len(data) - begin)
        folded = np.zeros(size + 2, np.uint32)
        seen = data[begin : begin + size + 2]
        folded[: len(seen)] = _FOLD[seen]
        at = np.arange(begin, begin + size)
        row = np.searchsorted(starts, at, "right") - 1
        left = starts[row + 1] - at
        first, last = int(row[0]), int(row[-1])
        cell = (row - first).astype(np.int32) * np.int32(DIMS)
        del at, row
        code = np.zeros(size, np.uint32)
        for n in (1, 2, 3):
            code = code * np.uint32(0x01000193) ^ folded[n - 1 : n - 1 + size]
            place = (code * np.uint32(0x9E3779B1) >> np.uint32(20)).astype(np.int32)
            found = np.bincount((cell + place)[left >= n], minlength=(last - first + 1) * DIMS)
            out[first : last + 1] += found.reshape(-1, DIMS)
    return out


def vectors(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counted.astype(np.float32)) * idf
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(length, 1e-12)[:, None]


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return W.row_groups(texts, 1 << 20, 512)


def length_class(size: np.ndarray) -> np.ndarray:
    return np.clip(np.frexp(np.maximum(size, 1))[1] - 1, 0, CLASSES - 1)


def pieces(text: bytes) -> list[bytes]:
    """The text, and from its middle one piece of each shorter length that has a cut-off."""
    out, size = [text], SHORTEST
    while size < min(len(text), 1 << CLASSES - 1):
        begin = (len(text) - size) // 2
        out.append(text[begin : begin + size])
        size *= 2
    return out


def cut_offs(held: DataFrame, idf: np.ndarray, labels: list[str], centroids: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The cut-off of each centroid and class, from the held-out pieces ``held(lang, v, size)``.

    A piece counts for the centroid that is nearest of all, and only if that is its label's.
    """
    out = np.repeat(least[:, None] * REACH, CLASSES, axis=1)
    if not len(labels):
        return out
    lang_of = np.array(labels, object)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                near = vectors(np.stack([np.frombuffer(v.as_buffer(), np.uint32) for v in part["v"]]), idf) @ centroids.T
                own = near.argmax(axis=1)
                columns = [part["lang"], pa.array(own, pa.int32()), part["size"], pa.array(near.max(axis=1).astype(float))]
                right = pa.array(lang_of[own] == part["lang"].to_numpy(zero_copy_only=False), pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "size", "score"]).filter(right)

    found = stored(held.select("lang", "v", "size").mapInArrow(nearest, "lang string, k int, size int, score double"))
    measured = (F.count("*").alias("n"), F.percentile("score", F.lit(LOW)).alias("low"))
    pooled = {(x.lang, x.size): x.low for x in found.groupBy("lang", "size").agg(*measured).collect()}
    own = {(x.k, x.size): x.low for x in found.groupBy("k", "size").agg(*measured).collect() if x.n >= LEAST_HELD}
    for k, lang in enumerate(labels):
        for c in range(int(SHORTEST).bit_length() - 1, CLASSES):
            low = own.get((k, c), pooled.get((lang, c)))
            out[k, c] = out[k, c - 1] if low is None else SLACK * low
    return out


def clustered(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of length one that have points of their own, and the smallest cosine between each and these."""
    rng = np.random.default_rng(7)
    centres = points[:1]
    while len(centres) < min(k, len(points)):  # k-means++
        far = np.maximum(1 - (points @ centres.T).max(axis=1).astype(float), 0) + 1e-9
        centres = np.vstack([centres, points[np.searchsorted(np.cumsum(far), rng.random() * far.sum()).clip(0, len(points) - 1)]])
    for _ in range(_ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.stack([points[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    near = points @ centres.T
    own = near.argmax(axis=1)
    used = np.unique(own)
    return centres[used].astype(np.float32), np.array([near[own == c, c].min() for c in used], np.float32)


def frequencies(known: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Texts by language, and in how many texts each place of a vector is not empty, of ``known(lang, text)``.

    Each task adds up its own; the driver gets a row for each language and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, int] = {}
        df = np.zeros(DIMS, np.int64)
        for batch in batches:
            for lang in batch["lang"].to_pylist():
                texts[lang] = texts.get(lang, 0) + 1
            for begin, stop in groups(batch["text"]):
                df += (counts(batch["text"].slice(begin, stop - begin)) > 0).sum(axis=0)
        seen = np.flatnonzero(df)
        columns = [[*texts, *[None] * len(seen)], [*[-1] * len(texts), *seen.tolist()], [*texts.values(), *df[seen].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "place", "n"])

    sums = known.select("lang", "text").mapInArrow(run, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    df, of_language = np.zeros(DIMS, np.int64), {}
    for r in sums.collect():
        if r.place < 0:
            of_language[r.lang] = r.n
        else:
            df[r.place] = r.n
    return of_language, df


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """The model of ``docs(doc_id, text, lang)``; rows with a null ``lang`` or without a letter teach nothing.

    Document frequencies are those of all these texts; the centroids and cut-offs are fitted on at most
    ``per_language`` of a language. Counting, document frequencies and
    the clustering of each language run as Spark tasks; the driver gets sums and the centroids.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", text_key("text")).alias("hash"))
    of_language, df = frequencies(known)
    n = sum(of_language.values())
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    # about four times as many as are wanted by a bound on the hash, then the smallest hashes of these
    share = docs.sparkSession.createDataFrame([(k, 4.0 * per_language / v) for k, v in sorted(of_language.items())], "lang string, share double")
    few = known.join(F.broadcast(share) if len(of_language) <= LISTED else share, "lang").where(F.pmod("hash", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 20)), "hash")
    sample = few.select("lang", "text", F.row_number().over(order).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in groups(batch["text"]):
                for lang, text, held in zip(*(batch[c].slice(begin, stop - begin).to_pylist() for c in ("lang", "text", "held")), strict=True):
                    cut = pieces(text) if held else [text]
                    rows = counts(pa.array(cut, pa.binary())).astype(np.uint32)
                    size = length_class(np.array([len(c) for c in cut]))
                    columns = (pa.array([lang] * len(cut), pa.string()), pa.array([r.tobytes() for r in rows], pa.binary()))
                    more = (pa.array([held] * len(cut), pa.bool_()), pa.array(size, pa.int32()), pa.array(np.arange(len(cut)) == 0, pa.bool_()))
                    yield pa.RecordBatch.from_arrays([*columns, *more], ["lang", "v", "held", "size", "whole"])

    chosen = sample.where(F.col("n") <= per_language).select("lang", "text", (F.col("n") % HELD_OUT == 0).alias("held"))
    vectorised = stored(chosen.mapInArrow(count, "lang string, v binary, held boolean, size int, whole boolean"))

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        fitted = np.stack([np.frombuffer(v, np.uint32) for v in sorted(rows["v"])])
        centres, least = clustered(vectors(fitted, idf), centroids)
        return pd.DataFrame({"c": [c.tobytes() for c in centres], "least": least.astype(float)})

    def named(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return cluster(rows).assign(lang=key[0])[["lang", "c", "least"]]

    found = vectorised.where("not held").groupBy("lang").applyInPandas(named, "lang string, c binary, least double").collect()
    found.sort(key=lambda r: (r.lang, r.c))
    matrix = np.stack([np.frombuffer(r.c, np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
    labels = [r.lang for r in found]
    least = cut_offs(vectorised.where("held"), idf, labels, matrix, np.array([r.least for r in found], float))
    return Model(idf, labels, matrix, least)


def identified(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` with ``out``: a struct of ``lang_pred``, ``score`` (the cosine) and ``rejected``.

    A null text or one without a letter is ``und`` with score 0 and rejected, and so is every text
    if nothing was learned. Only ``text`` is looked at; a narrow plan, no shuffle.
    """
    schema = "struct<lang_pred: string, score: double, rejected: boolean>"
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    names = docs.columns
    (marked,) = free_names(docs, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*model.labels, UNKNOWN], object)
        least = np.vstack([model.least, np.full((1, CLASSES), 2.0)])
        for batch in batches:
            best, score = np.full(batch.num_rows, len(model.labels)), np.zeros(batch.num_rows)
            size = length_class(np.diff(W.text_bytes(batch["text"])[1]))
            letters = batch[marked].to_numpy(zero_copy_only=False)
            for begin, stop in groups(batch["text"]) if len(model.labels) else ():
                near = vectors(counts(batch["text"].slice(begin, stop - begin)), model.idf) @ model.centroids.T
                best[begin:stop], score[begin:stop] = near.argmax(axis=1), near.max(axis=1)
            best, score = np.where(letters, best, len(model.labels)), np.where(letters, np.clip(score, 0, 1), 0.0)
            found = pa.StructArray.from_arrays(
                [pa.array(labels[best], pa.string()), pa.array(score), pa.array(score < least[best, size])], fields=list(kind)
            )
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), found], [*names, out])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn(marked, has_letter).mapInArrow(run, f"{fields}, `{out}` {schema}")
