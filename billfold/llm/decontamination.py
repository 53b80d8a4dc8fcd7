"""Benchmark items found in training texts: BM25 over an inverted index with block maxima.

The items are the indexed documents, each passage of a training text is a query. An impact is a
term's BM25 weight in an item as a share of the item's own full score, so that one threshold
holds for all items. As in block-max WAND, a passage is dropped whose terms' largest impacts
together stay under the threshold; then blocks of neighbouring items are dropped whose block
maxima do; only the items of what is left are scored. Both bounds are never below a score, so nothing
above the threshold is lost. The tests are made for all passages of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import text_key

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # share of the item's own score
QUESTION, ANSWER = 0.7, 0.5  # shares of words under shared runs
RUN = 5  # words of such a run
BLOCK = 8  # items
SHARD_WORDS = 1_000_000  # words of the items that one broadcast index holds


@dataclass
class Index:
    """Items are numbers, postings are sorted by term and item; the block lists likewise."""

    terms: np.ndarray
    top: np.ndarray  # largest impact of each term
    at: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    ids: list
    runs: list  # of each item, the hashes of its runs of words
    answer: list  # where its answer begins
    lengths: list  # its words
    stride: int
    slots: np.ndarray
    bits: int

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's term, or -1: open addressing over the hashes' high bits."""
        place = (words >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.full(len(words), -1, np.int32)
        open_ = np.arange(len(words))
        while len(open_):
            slot = self.slots[place[open_]]
            hit = (slot >= 0) & (self.terms[slot] == words[open_])
            found[open_[hit]] = slot[hit]
            open_ = open_[(slot >= 0) & ~hit]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        return found


def build(ids: list, texts: pa.Array, df: dict[int, int], n_items: int, mean_words: float) -> Index:
    hashes, bounds = W.words_of(texts)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(ids)), count)
    pair = np.rec.fromarrays([hashes, owner], names="term,item")
    unique, tf = np.unique(pair, return_counts=True)
    term, item = unique["term"], unique["item"].astype(np.int64)
    terms, number = np.unique(term, return_inverse=True)
    seen = np.array([df[t] for t in terms.tolist()], float)
    idf = np.log1p((n_items - seen + 0.5) / (seen + 0.5))
    norm = K1 * (1 - B + B * count / max(mean_words, 1))
    weight = idf[number] * tf * (K1 + 1) / (tf + norm[item])
    impact = weight / np.bincount(item, weight, len(ids))[item]
    at = np.searchsorted(number, np.arange(len(terms) + 1))
    blocks, owner_of_block = np.unique(number * (1 << 32) + item // BLOCK, return_inverse=True)
    block_top = np.zeros(len(blocks))
    np.maximum.at(block_top, owner_of_block, impact)
    bits = max(4, int(len(terms) * 4).bit_length())
    slots = np.full(1 << bits, -1, np.int32)
    for i, place in enumerate((terms >> np.uint64(64 - bits)).tolist()):
        while slots[place] >= 0:
            place = (place + 1) & ((1 << bits) - 1)
        slots[place] = i
    runs = [
        W.shingles(hashes[a:b], np.array([0, b - a]), min(RUN, b - a))[0] if b > a else hashes[:0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]
    answer = [int(n - min(n, max(RUN, n // 4))) for n in count]
    longest = int(count.max(initial=1))
    return Index(
        terms, np.maximum.reduceat(impact, at[:-1]) if len(terms) else impact, at, item, impact,
        np.searchsorted(blocks >> 32, np.arange(len(terms) + 1)), blocks & 0xFFFFFFFF, block_top,
        ids, runs, answer, count.tolist(), max(64, longest), slots, bits,
    )


def expand(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all list entries of these terms, and for each the number of its term here."""
    count = at[which + 1] - at[which]
    source = np.repeat(np.arange(len(which)), count)
    place = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[which], count)
    return place, source


def retrieve(index: Index, words: np.ndarray, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """``(row, first word, item, score)`` of each passage and item at or above the threshold.

    A passage is two strides of words, the next begins a stride later; no item is longer than a
    stride, so each lies whole in a passage.
    """
    stride, n_terms, n_items = index.stride, len(index.terms), len(index.ids)
    count = np.diff(bounds)
    per_row = np.maximum(1, -(-count // stride) - 1)
    first = np.concatenate([[0], np.cumsum(per_row)])
    term = index.look_up(words)
    known = np.flatnonzero(term >= 0)
    row = np.searchsorted(bounds, known, "right") - 1
    step = (known - bounds[row]) // stride
    early, late = np.maximum(step - 1, 0), np.minimum(step, per_row[row] - 1)
    passage = np.concatenate([first[row] + early, (first[row] + late)[early < late]])
    term = np.concatenate([term[known], term[known][early < late]])
    distinct = np.unique(passage * n_terms + term)
    passage, term = distinct // max(n_terms, 1), distinct % max(n_terms, 1)

    slack = threshold - 1e-9
    able = np.bincount(passage, index.top[term], int(first[-1])) >= slack
    keep = able[passage]
    passage, term = passage[keep], term[keep]
    place, source = expand(index.block_at, term)
    n_blocks = -(-n_items // BLOCK)
    cells, cell = np.unique(passage[source] * n_blocks + index.block[place], return_inverse=True)
    live = cells[np.bincount(cell, index.block_top[place], len(cells)) >= slack]

    keep = np.isin(passage, live // n_blocks)
    passage, term = passage[keep], term[keep]
    place, source = expand(index.at, term)
    inside = np.isin(passage[source] * n_blocks + index.item[place] // BLOCK, live)
    place, source = place[inside], source[inside]
    cells, cell = np.unique(passage[source] * n_items + index.item[place], return_inverse=True)
    score = np.bincount(cell, index.impact[place], len(cells))
    cells, score = cells[score >= slack], score[score >= slack]
    row = np.searchsorted(first, cells // n_items, "right") - 1
    return row, bounds[row] + (cells // n_items - first[row]) * stride, cells % n_items, score


def overlap(index: Index, item: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and the answer's words under runs that the passage has too."""
    wanted, length, cut = index.runs[item], index.lengths[item], index.answer[item]
    n = min(RUN, length)
    hit = np.isin(wanted, W.shingles(passage, np.array([0, len(passage)]), n)[0])
    covered = np.zeros(length, bool)
    for i in range(n):
        covered[i : i + len(hit)] |= hit
    return float(covered[: cut or None].mean()), float(covered[cut:].mean())


def hits(index: Index, texts: pa.Array, threshold: float, question: float, answer: float) -> dict[tuple[int, int], tuple]:
    """For each row and item found: place of the best passage, score, overlap of question and answer."""
    best: dict[tuple[int, int], tuple] = {}
    for begin, stop in W.row_groups(texts):
        words, bounds = W.words_of(texts.slice(begin, stop - begin))
        for row, at, item, score in zip(*(x.tolist() for x in retrieve(index, words, bounds, threshold)), strict=True):
            q, a = overlap(index, item, words[at : min(at + 2 * index.stride, bounds[row + 1])])
            if q >= question and a >= answer:
                found = (score, q, a, -int(at - bounds[row]))
                best[begin + row, item] = max(best.get((begin + row, item), found), found)
    return best


def indexes(items: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[Index]:
    """The index of ``items(item_id, text)`` in shards of bounded size; weights are those of all items.

    Items without words are in none. A shard holds about ``shard_words`` words, so what a task
    gets is bounded however large the benchmark is.
    """
    items = items.select("item_id", "text", text_key("text").alias("key"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = W.words_of(batch["text"])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pairs = np.unique(np.rec.fromarrays([owner, hashes], names="owner,term"))
            yield pa.RecordBatch.from_arrays([pa.array(pairs["term"].copy().view(np.int64))], ["term"])

    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    full = items.withColumn("n", n_words).where("n > 0")
    n_items, total = full.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-total // shard_words))
    df = items.select("text").mapInArrow(terms, "term bigint").groupBy("term").agg(F.count("*").alias("df"))
    for shard in range(shards if n_items else 0):
        mine = full.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(shards)) == shard)
        if shards == 1:
            counted = df.collect()
        else:
            counted = df.join(mine.select("text").mapInArrow(terms, "term bigint").distinct(), "term").collect()
        rows = sorted(mine.select("item_id", "text").collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        seen = {int(np.int64(r.term).view(np.uint64)): r.df for r in counted}
        if rows:
            yield build([r.item_id for r in rows], pa.array([r.text for r in rows]), seen, n_items, total / n_items)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    question: float = QUESTION,
    answer: float = ANSWER,
) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, first_word)``, a row per document and item found.

    ``docs(doc_id, text)``, ``items(item_id, text)``; an item's answer is the last quarter of its
    words, five at least, the question the rest (of five words or fewer both are all of it).
    ``score`` is the share of the item's own BM25 score, ``first_word`` where the passage begins
    in the text. Null or empty texts hold and are nothing; repeated rows are answered each.
    """
    out = None
    columns = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word")
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids = batch["doc_id"].to_pylist()
                rows = [
                    (doc_ids[row], index.ids[item], round(s, 9), q, a, -w)
                    for (row, item), (s, q, a, w) in hits(index, batch["text"], threshold, question, answer).items()
                ]
                data = zip(*rows, strict=True) if rows else [[]] * len(columns)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(data, kinds, strict=True)], columns)

        found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    question: float = QUESTION,
    answer: float = ANSWER,
) -> DataFrame:
    """``docs``, all columns, without the rows whose ``text`` holds an item; one pass, no shuffle."""
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _ in hits(index, batch["text"], threshold, question, answer):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
