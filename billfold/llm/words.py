"""Words and word shingles of Arrow text columns as 64-bit hashes, worked out with numpy inside tasks.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. A text's bytes are hashed in segments cut between words, so the memory
needed beside the text follows the segment, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes hashed at once; a longer word is hashed whole

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[_SPACE] = 0
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, SEGMENT + 1), _powers(_ODD_INVERSE, SEGMENT + 1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    x = x + np.uint64((int(salt) * _ODD + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and where each row's begin (one entry more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.cast(pa.large_binary() if large else pa.binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _segments(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the bytes that together cover them, each ending at a row's end or at a blank."""
    begin, end = 0, len(data)
    while begin < end:
        stop = min(begin + SEGMENT, end)
        if stop < end:
            row = starts[np.searchsorted(starts, stop, "right") - 1]
            if row > begin:
                stop = int(row)
            else:
                blanks = np.flatnonzero(_SPACE[data[begin:stop]])
                if len(blanks):
                    stop = begin + int(blanks[-1]) + 1
                else:
                    limit = int(starts[np.searchsorted(starts, begin, "right")])
                    while stop < limit and not _SPACE[data[stop]]:
                        stop += 1
        yield begin, stop
        begin = stop


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, byte place of every word, and number of words before each row's first."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, stop in _segments(data, starts):
        part = data[begin:stop]
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = starts[np.searchsorted(starts, begin, "left") : np.searchsorted(starts, stop, "left")] - begin
        first[cuts] = inside[cuts]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        up, down = (_UP, _DOWN) if len(part) <= SEGMENT else (_powers(_ODD, len(part)), _powers(_ODD_INVERSE, len(part)))
        values = _VALUES[part]
        values *= up[: len(part)]
        words = np.add.reduceat(values, at) * down[at]
        hashes.append(mix(words))
        places.append(at + begin)
    place = np.concatenate(places)
    return np.concatenate(hashes), place, np.searchsorted(place, starts, "left")


def word_ends(data: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Byte places behind the words that begin at ``place``."""
    blanks = np.flatnonzero(_SPACE[data])
    after = np.append(blanks, len(data))[np.searchsorted(blanks, place)]
    return np.minimum(after, starts[np.searchsorted(starts, place, "right")])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the bounds of each row's among them."""
    data, starts = text_bytes(column)
    hashes, _, bounds = hash_words(data, starts)
    return hashes, bounds


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words in each row, in order, and their bounds.

    A row with fewer words has one shingle of all of them; a row without words has none.
    """
    count = np.diff(bounds)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    total = int(out_bounds[-1])
    at = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], made)
    left = np.repeat(bounds[1:], made) - at
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = np.zeros(total, np.uint64)
    for i in range(n):
        out *= np.uint64(_ODD)
        out += np.where(left > i, padded[at + i], np.uint64(0))
        out ^= out >> np.uint64(29)
    out += np.minimum(left, n).astype(np.uint64)
    return mix(out, n), out_bounds


def row_groups(column: pa.Array, size: int = 2 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``size`` bytes, one row at least: arrays made of them stay small."""
    _, starts = text_bytes(column)
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(starts, starts[begin] + size, "right")) - 1)
        stop = min(stop, begin + rows)
        yield begin, stop
        begin = stop


def sliced(batches: Iterator[pa.RecordBatch], text: str, size: int = 2 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of the text column, so that few texts are Python objects at once."""
    for batch in batches:
        for begin, stop in row_groups(batch[text], size, rows):
            yield batch.slice(begin, stop - begin)
