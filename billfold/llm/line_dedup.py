"""Repeated lines and sentences across documents, found by their digests.

A unit is a sentence of a line: it ends with the line, with a word that ends in a full stop, an
exclamation or a question mark, and, so that lines without these are cut too, with a word of 7, 15,
23 ... bytes. These cuts depend on the words alone, so a passage glued into another text is
cut as where it stood first, all but its borders. Normalised, a unit is its words in lower case (A-Z) with one
blank between. Of equal units the earliest stays: by doc_id (null last), text and place. A run of
neighbouring units that all have an earlier occurrence goes where it has ``min_words`` words or
more; a shorter run, such as one boilerplate line, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import dealt_join, free_names, stored, text_key

MIN_WORDS = 25  # what is whole units of a passage of over 50 words, its cut borders taken off
_KEY = ["doc_id", "text_key"]
_DIGEST = 10
_MARKS = np.frombuffer(b".!?", np.uint8)


def cut_units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number, first and last code point place, words and digest (two values) of every unit of these texts."""
    hashes, place, bounds = W.hash_words(data, starts)
    if not len(hashes):
        return (*[np.zeros(0, np.int64)] * 5, np.zeros((0, 2), np.uint64))
    end = W.word_ends(data, starts, place)
    closes = np.isin(data[end - 1], _MARKS) | ((end - place) % 8 == 7)
    line = np.searchsorted(np.flatnonzero(data == 10), place)
    closes[:-1] |= line[1:] != line[:-1]
    closes[bounds[1:][np.diff(bounds) > 0] - 1] = True
    last = np.flatnonzero(closes)
    first = np.concatenate([[0], last[:-1] + 1])
    n_words = last - first + 1
    inside = (np.arange(len(hashes)) - np.repeat(first, n_words)).astype(np.uint64)
    ordered = hashes ^ W.mix(inside)
    digest = np.stack([np.add.reduceat(W.mix(ordered, salt), first) for salt in (1, 2)], axis=1)
    row = np.searchsorted(bounds, first, "right") - 1
    number = np.arange(len(first)) - np.searchsorted(row, row)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    before = points[starts[row]]
    return row, number, points[place[first]] - before, points[end[last]] - before, n_words, digest


def telling(docs: DataFrame) -> Column:
    """What tells rows of one id apart: a hash of the text, or 0 for all where every row has an id of its own."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return F.lit(0).cast("bigint") if n == ids else text_key("text")


def units(docs: DataFrame, key: Column) -> DataFrame:
    """``(doc_id, text_key, unit_no, start, end, n_words, digest)``; places count code points.

    Digests are cut to ten bytes.
    """
    names = ["doc_id", "text_key", "unit_no", "start", "end", "n_words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.sliced(batches, "text"):
            row, number, start, end, n_words, digest = cut_units(*W.text_bytes(part["text"]))
            ids = [part[c].take(pa.array(row)) for c in _KEY]
            numbers = [pa.array(c.astype(np.int32)) for c in (number, start, end, n_words)]
            cut = np.ascontiguousarray(digest.view(np.uint8).reshape(-1, 16)[:, :_DIGEST])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_DIGEST), len(cut), [None, pa.py_buffer(cut)])
            yield pa.RecordBatch.from_arrays([*ids, *numbers, packed.cast(pa.binary())], names)

    schema = "doc_id bigint, text_key bigint, unit_no int, start int, end int, n_words int, digest binary"
    return docs.select("doc_id", key.alias("text_key"), "text").mapInArrow(run, schema)


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The units that go, each with the occurrence that stays.

    ``(doc_id, text_key, start, end, n_words, run_words, kept_doc_id, kept_start)``, ``run_words`` those of its whole run, for ``docs(doc_id, text)``;
    a null or empty text has no unit, other columns are not looked at. Rows alike in id and text
    are one document: each stands for both, and neither repeats the other. ``text_key`` tells texts of one id
    apart, and is 0 where all ids differ.

    The earliest occurrence is a partial aggregate on the digest; a digest that a third of all
    units share sends one row per task. Only digests that occur twice are joined to the units, and
    the units of very frequent ones are dealt out for that.
    """
    return _repeated(docs, telling(docs), min_words).drop("unit_no")


def _repeated(docs: DataFrame, key: Column, min_words: int, places: bool = True) -> DataFrame:
    """The same with ``unit_no``; without ``places`` the units are only numbered, their places are not carried along."""
    carried = ["start", "end"] if places else []
    kept = ["kept_doc_id", "kept_start"] if places else []
    found = stored(units(docs, key).select(*_KEY, "unit_no", *carried, "n_words", "digest"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "start" if places else "unit_no")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1"))
    later = dealt_join(found, first.drop("n"), "digest", first, found.count()).where(~rank.eqNullSafe(F.col("first")))
    if places:
        later = later.withColumns({"kept_doc_id": F.col("first.doc_id"), "kept_start": F.col("first.start").cast("bigint")})
    later = later.select(*_KEY, "unit_no", *carried, "n_words", *kept)
    in_text = Window.partitionBy(*_KEY).orderBy("unit_no")
    before = F.lag("unit_no").over(in_text)
    once = later.withColumn("before", before).where("before is null or before <> unit_no").drop("before")  # rows given twice
    runs = once.withColumn("run", F.col("unit_no") - F.row_number().over(in_text))
    words = F.sum("n_words").over(Window.partitionBy(*_KEY, "run"))
    found = runs.withColumn("run_words", words).where(F.col("run_words") >= min_words)
    return found.select(*_KEY, "unit_no", *(F.col(c).cast("bigint").alias(c) for c in (*carried, "n_words", "run_words")), *kept)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, length: str | None = None) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``; ``length``, if given, is set to what is left.

    A text without any removal is returned as it is; a document of which no word is left goes.
    """
    own = telling(docs)
    numbers = _repeated(docs, own, min_words, places=False).groupBy(*_KEY).agg(F.sort_array(F.collect_list("unit_no")).alias("units"))
    id_, key, gone = free_names(docs, "id", "key", "units")
    keyed = docs.withColumns({id_: F.col("doc_id"), key: own})
    on = keyed[id_].eqNullSafe(numbers["doc_id"]) & (keyed[key] == numbers["text_key"])
    joined = keyed.join(numbers, on, "left").select(*(keyed[c] for c in docs.columns), F.col("units").alias(gone))

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.sliced(batches, "text"):
            numbers_of = part[gone].to_pylist()
            touched = [i for i, numbers in enumerate(numbers_of) if numbers]
            row, _, start, end, _, _ = cut_units(*W.text_bytes(part["text"].take(pa.array(touched, pa.int64()))))
            spans_of: list[list[dict] | None] = [None] * part.num_rows
            for i, first in zip(touched, np.searchsorted(row, np.arange(len(touched))).tolist(), strict=True):
                spans_of[i] = [{"start": int(start[first + k]), "end": int(end[first + k])} for k in numbers_of[i]]
            texts = [t if g is None else cut(t, g) for t, g in zip(part["text"].to_pylist(), spans_of, strict=True)]
            columns = {c: part[c] for c in names} | {"text": pa.array(texts, part["text"].type)}
            if length:
                old = part[length].to_pylist()
                new = [n if g is None else len(t) for n, t, g in zip(old, texts, spans_of, strict=True)]
                columns[length] = pa.array(new, part[length].type)
            stays = [g is None or bool(t.encode().split()) for t, g in zip(texts, spans_of, strict=True)]
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(stays, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def cut(text: str, gone: list[dict]) -> str:
    """The text without these units and the blanks behind them; a line of which nothing is left goes with its end."""
    parts, at = [], 0
    for span in gone:
        parts.append(text[at : span["start"]])
        at = span["end"]
        while at < len(text) and text[at] in " \t\v\f\r":
            at += 1
        if text[at : at + 1] == "\n":
            before = next((p for p in reversed(parts) if p), "\n")
            at += before.endswith("\n")
    left = "".join(parts) + text[at:]
    return left[:-1] if at >= len(text) and left.endswith("\n") else left
