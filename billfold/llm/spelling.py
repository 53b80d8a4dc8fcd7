"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and itself.

The composed machine's states are (state of the acceptor, edit done or not, state of the acceptor).
Until the edit both sides have read the same, so a pair of words lies below the start state that
their common beginning leads to; and if the edit falls into the first half, below the one of the
reversed acceptor that their common end leads to. Pairs are therefore enumerated per start state:
a partition holds the words alike in the first (or, reversed, the last) half of the shorter word's length,
and no pair is in two of them. The acceptors of a partition's shorter and longer
words are minimised as they are built from the sorted words, and number their words, so that an
accepting path of the composition is two numbers, however long the words are. Partitions of a task share
the states of one acceptor, and with them what two states were found to accept both.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import stored

MODULUS = 97  # one occurrence in so many loses a code point
MIN_LENGTH, MIN_COUNT = 5, 3
BLOCK = 8 << 20  # bytes of texts whose words are counted at once
FLUSH = 1 << 18  # distinct words a task holds before it hands their counts on
STATES = 1 << 18  # states, pairs of them and pairs of strings that an acceptor holds before the next partition gets a new one
_DEEP = 200  # symbols; what longer strings have in common is walked, not kept
_SHORT = 64  # bytes of the words that are hashed as arrays; longer ones are looked at one by one

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more


def _crc_tables() -> np.ndarray:
    """What a byte adds to a message's CRC-32, by its distance from the end: the checksum is linear over exclusive or."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    out = [table]
    for _ in range(_SHORT - 1):
        out.append(table[out[-1] & np.uint32(255)] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


_CRC = _crc_tables()
_TABULATED = np.random.default_rng(97).integers(1, 1 << 63, (_SHORT, 256), dtype=np.uint64)


def _after(crcs: np.ndarray) -> np.ndarray:
    """The CRCs of messages followed by 0, 1, 2 ... zero bytes; a word's own part is added to these."""
    register = crcs ^ np.uint32(0xFFFFFFFF)
    out = [register]
    for _ in range(_SHORT):
        register = _CRC[0][register & np.uint32(255)] ^ (register >> np.uint32(8))
        out.append(register)
    return np.stack(out, axis=1) ^ np.uint32(0xFFFFFFFF)


def _without(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def _count(data: np.ndarray, starts: np.ndarray, prefixes: list[bytes], counts: dict[str, int]) -> None:
    """Adds the words of these rows' bytes to the counts."""
    data = _LOWER[data]
    letter = _IS_LETTER[data]
    lead = data == _LEAD
    letter |= lead
    letter[1:] |= lead[:-1]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = starts[:-1][starts[:-1] < len(data)]
    first[begins] = letter[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return
    letters = np.flatnonzero(letter).astype(np.int32)
    offset = np.searchsorted(letters, at)
    length = np.diff(offset, append=len(letters))
    row = np.searchsorted(starts, at, "right") - 1

    for i in np.flatnonzero(length > _SHORT):
        text = data[at[i] : at[i] + length[i]].tobytes()
        h, word = zlib.crc32(prefixes[row[i]] + text), text.decode()
        word = word if h % MODULUS else _without(word, h % len(word))
        if len(word) >= MIN_LENGTH:
            counts[word] = counts.get(word, 0) + 1

    ends = np.repeat((offset + length - 1).astype(np.int32), length)
    back = np.minimum(ends - np.arange(len(letters), dtype=np.int32), np.int32(_SHORT - 1))
    cell = (back << np.int32(8)) + data[letters]
    del back, letters, ends
    crc = np.bitwise_xor.reduceat(_CRC.ravel()[cell], offset)
    key = np.bitwise_xor.reduceat(_TABULATED.ravel()[cell], offset)
    del cell
    taken = np.flatnonzero((length >= MIN_LENGTH) & (length <= _SHORT))
    at, length, row, crc, key = at[taken], length[taken], row[taken], crc[taken], key[taken]
    before = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    h = _after(before)[row, length] ^ crc
    hit = h % np.uint32(MODULUS) == 0
    for i in np.flatnonzero(hit):
        word = data[at[i] : at[i] + length[i]].tobytes().decode()
        word = _without(word, int(h[i]) % len(word))
        if len(word) >= MIN_LENGTH:
            counts[word] = counts.get(word, 0) + 1
    keep = ~hit
    at, length = at[keep], length[keep]
    _, one, n = np.unique(key[keep], return_index=True, return_counts=True)
    whole = data.tobytes()
    for begin, size, times in zip(at[one].tolist(), length[one].tolist(), n.tolist(), strict=True):
        word = whole[begin : begin + size].decode()
        if len(word) >= MIN_LENGTH:
            counts[word] = counts.get(word, 0) + times


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: the words of ``docs(doc_id, text)`` that occur often enough.

    Each task adds up its own before the shuffle. Long texts are counted in segments cut between words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in W.sliced(batches, "text", size=BLOCK):
            data, starts = W.text_bytes(batch["text"])
            prefixes = [(b"" if i is None else b"%d" % i) + b":" for i in batch["doc_id"].to_pylist()]
            for begin, stop, rows in _segments(data, starts):
                _count(data[begin:stop], np.clip(starts[rows.start : rows.stop + 1], begin, stop) - begin, prefixes[rows], counts)
                if len(counts) >= FLUSH:
                    yield out()
        if counts:
            yield out()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _segments(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """Ranges of about a block that together are all bytes, cut between rows or else between words, each with its rows."""
    begin, end = 0, len(data)
    while begin < end:
        stop = min(begin + BLOCK, end)
        if stop < end:
            border = int(starts[np.searchsorted(starts, stop, "right") - 1])
            if border > begin:
                stop = border
            else:  # inside a row, behind an ASCII byte that is no letter, if there is one
                limit = int(starts[np.searchsorted(starts, begin, "right")])
                while stop < limit and (data[stop - 1] >= 128 or _IS_LETTER[_LOWER[data[stop - 1]]]):
                    stop += 1
        rows = slice(int(np.searchsorted(starts, begin, "right")) - 1, int(np.searchsorted(starts, stop, "left")))
        yield begin, stop, rows
        begin = stop


class Acceptor:
    """A minimal acyclic acceptor of several sets of sorted strings, a start state each, which numbers a set's strings in order.

    ``arcs[state]`` leads from a symbol to the next state and to how many of the state's strings come
    before those that go on with the symbol. Equal states are one, whichever set they came with, so
    what two states have in common is worked out once.
    """

    def __init__(self):
        self.final: list[bool] = []
        self.size: list[int] = []
        self.height: list[int] = []  # symbols of the longest string
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self._register: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._replaced: dict[int, list[tuple[int, int]]] = {}
        self._inserted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._held = 0  # pairs of strings in these

    def is_full(self) -> bool:
        return len(self.final) + len(self._common) + len(self._inserted) + self._held > STATES

    def _closed(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self._register.get(key)
        if state is None:
            state = self._register[key] = len(self.final)
            before, numbered, height = int(final), {}, 0
            for symbol, to in arcs:
                numbered[symbol] = (to, before)
                before += self.size[to]
                height = max(height, self.height[to] + 1)
            self.final.append(final)
            self.size.append(before)
            self.height.append(height)
            self.arcs.append(numbered)
        return state

    def add(self, strings: list[str]) -> int:
        """The start state of a set of strings, given in order without repeats."""
        path: list[list] = [[False, []]]  # the states of the last string: final, (symbol, state) so far
        last = ""
        for string in [*strings, ""]:
            same, limit = 0, min(len(last), len(string))
            while same < limit and last[same] == string[same]:
                same += 1
            while len(path) > same + 1:
                state = self._closed(*path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path.extend([False, []] for _ in string[same:])
            if string or (strings and not strings[0]):
                path[-1][0] = True
            last = string
        return self._closed(*path[0])

    def common(self, s: int, t: int) -> list[tuple[int, int]]:
        """The numbers, in either state, of the strings that both accept."""
        if min(self.height[s], self.height[t]) > _DEEP:
            return list(self._walk(s, t))
        found = self._common.get((s, t))
        if found is None:
            if s == t:
                found = [(k, k) for k in range(self.size[s])]
            else:
                found = [(0, 0)] if self.final[s] and self.final[t] else []
                mine, other = self.arcs[s], self.arcs[t]
                for symbol in mine.keys() & other.keys():
                    (to, n), (there, m) = mine[symbol], other[symbol]
                    found.extend((i + n, j + m) for i, j in self.common(to, there))
            self._common[s, t] = found
            self._held += len(found)
        return found

    def _walk(self, s: int, t: int) -> Iterator[tuple[int, int]]:
        """The same for strings of any length, nothing kept."""
        waiting = [(s, 0, t, 0)]
        while waiting:
            s, i, t, j = waiting.pop()
            if self.final[s] and self.final[t]:
                yield i, j
            mine, other = self.arcs[s], self.arcs[t]
            for symbol in mine.keys() & other.keys():
                (to, n), (there, m) = mine[symbol], other[symbol]
                waiting.append((to, i + n, there, j + m))

    def replaced(self, start: int) -> Iterator[tuple[int, int]]:
        """Numbers of the pairs of a set's strings that differ in one symbol, each pair once."""
        waiting = [(start, 0)]
        while waiting:
            state, base = waiting.pop()
            if self.height[state] <= _DEEP:
                for i, j in self._replaced_in(state):
                    yield base + i, base + j
                continue
            arcs = list(self.arcs[state].values())
            for place, (to, n) in enumerate(arcs):
                if self.size[to] > 1:
                    waiting.append((to, base + n))
                for there, m in arcs[place + 1 :]:
                    for i, j in self.common(to, there):
                        yield base + n + i, base + m + j

    def _replaced_in(self, state: int) -> list[tuple[int, int]]:
        found = self._replaced.get(state)
        if found is None:
            found = self._replaced[state] = []
            arcs = list(self.arcs[state].values())
            for place, (to, n) in enumerate(arcs):
                if self.size[to] > 1:
                    found.extend((i + n, j + n) for i, j in self._replaced_in(to))
                for there, m in arcs[place + 1 :]:
                    found.extend((i + n, j + m) for i, j in self.common(to, there))
            self._held += len(found)
        return found

    def inserted(self, long: int, short: int) -> Iterator[tuple[int, int]]:
        """Numbers of the pairs in which a string of the first set is one of the second and one symbol more, each pair once.

        The symbol counts as inserted at the end of what the two have in common, so it is not followed by itself.
        """
        waiting = [(long, 0, short, 0)]
        while waiting:
            s, i, t, j = waiting.pop()
            if min(self.height[s], self.height[t]) <= _DEEP:
                for x, y in self._inserted_in(s, t):
                    yield i + x, j + y
                continue
            other = self.arcs[t]
            for symbol, (to, n) in self.arcs[s].items():
                for x, y in self._inserted_here(symbol, to, t):
                    yield i + n + x, j + y
                if symbol in other:
                    there, m = other[symbol]
                    waiting.append((to, i + n, there, j + m))

    def _inserted_here(self, symbol: str, to: int, t: int) -> Iterator[tuple[int, int]]:
        """The strings behind the symbol that ``t`` has too, without those that begin with it once more."""
        if self.final[to] and self.final[t]:
            yield 0, 0
        further, other = self.arcs[to], self.arcs[t]
        for after in further.keys() & other.keys():
            if after != symbol:
                (a, k), (b, m) = further[after], other[after]
                for x, y in self.common(a, b):
                    yield k + x, m + y

    def _inserted_in(self, s: int, t: int) -> list[tuple[int, int]]:
        found = self._inserted.get((s, t))
        if found is None:
            found = self._inserted[s, t] = []
            other = self.arcs[t]
            for symbol, (to, n) in self.arcs[s].items():
                found.extend((n + x, y) for x, y in self._inserted_here(symbol, to, t))
                if symbol in other:
                    there, m = other[symbol]
                    found.extend((n + x, m + y) for x, y in self._inserted_in(to, there))
            self._held += len(found)
        return found


def _near(acceptor: Acceptor, length: int, reverse: bool, group: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """``(word, number of near words, n of the commonest, the commonest)`` from the pairs of a partition."""
    half = length // 2
    both = []
    for size in (length, length + 1):
        words = [(w[: size - (length - half)][::-1] if reverse else w[half:], w, n) for w, n in group if len(w) == size]
        both.append(sorted(words))
    if not both[0]:
        return
    short, long = (acceptor.add([s for s, _, _ in words]) for words in both)
    found: dict[str, list] = {}

    def note(word: str, near: str, n: int) -> None:
        mine = found.get(word)
        if mine is None:
            found[word] = [1, -n, near]
        else:
            mine[0] += 1
            if (-n, near) < (mine[1], mine[2]):
                mine[1:] = -n, near

    for pairs, left in ((acceptor.replaced(short), both[0]), (acceptor.inserted(long, short), both[1])):
        for i, j in pairs:
            (_, x, n), (_, y, m) = left[i], both[0][j]
            if reverse and x[:half] == y[:half]:
                continue  # the partition of the first half has it
            note(x, y, m)
            note(y, x, n)
    for word, (times, n, near) in found.items():
        yield word, times, -n, near


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` for the words of ``words(word, n)`` that have a near one; ``near`` is the commonest.

    Every word goes to four partitions: by its first and its last half, as the shorter and as the longer one.
    """
    length = F.char_length("word")

    def part(shorter, reverse: bool):
        half = F.expr("int(length(word) div 2)") if shorter is length else F.expr("int((length(word) - 1) div 2)")
        size = shorter - half
        key = F.substring("word", -size, size) if reverse else F.substring("word", F.lit(1), half)
        return F.struct(shorter.alias("length"), F.lit(reverse).alias("reverse"), key.alias("key"))

    parts = [part(s, r) for s in (length, length - 1) for r in (False, True)]
    dealt = words.select("word", "n", F.explode(F.array(*parts)).alias("p")).select("p.length", "p.reverse", "p.key", "word", "n")
    names = ("length", "reverse", "key", "word", "n")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in names), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "near_n", "near"])

        acceptor = Acceptor()
        for (length, reverse, _), group in groupby(rows(batches), key=lambda r: r[:3]):
            members = [(r[3], r[4]) for r in group]
            if len(members) > 1:
                if acceptor.is_full():
                    acceptor = Acceptor()
                out.extend(_near(acceptor, length, reverse, members))
            if len(out) >= 1 << 14:
                yield batch()
        if out:
            yield batch()

    key = ("length", "reverse", "key")
    found = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words of ``forms(word, form)``: the last one that is reached from form to form.

    A form is twice as common as its word, so there is no circle, and the way is at most as long
    as the logarithm of the largest count; every round doubles what has been gone of it.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs(doc_id, text)``.

    Words are runs of Latin letters in lower case (A-Z only), with the one code point removed that
    the checksum of the document's id and the run picks in one of 97 cases; of at least five code
    points and ``min_count`` occurrences. A word's form is its near word of largest n, the
    smallest of those that tie, if it is twice as common or more. A null or empty text has no
    words; a null id reads as empty in the checksum; a repeated row counts each time; no rows give none. Other columns are
    not looked at. The words of one length that share a half are in one task.
    """
    words = stored(vocabulary(docs, min_count))
    near = near_words(words)
    has_form = F.col("near_n") >= 2 * F.col("n")
    formed = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"),
        )
    )
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
