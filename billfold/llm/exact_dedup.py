"""Equal texts, found by inserting their bytes into Patricia tries whose terminals hold the owner.

Two texts are equal where they are the same bytes once A-Z are lower-cased; a null text counts as
empty. Each task first puts the texts of its own rows into a trie, so that of the copies among
them one string is sent on, however many there are. These strings are partitioned by length and
content hash; a second trie per partition merges the owners. A digest decides where a string goes,
never whether two are equal. A trie that outgrows its budget spills its largest subtree: the
first kind hands the strings below it on as they are (a later copy becomes another string of the
same partition), the second gives out the owners below it, complete as keys come in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billfold.llm import words as W
from billfold.llm.tables import stored

BUDGET = 32 << 20  # bytes of labels and nodes that a trie holds before it spills
_NODE = 250  # bytes that a node takes beside its label
_OUT = 4 << 20  # bytes of strings, and so many rows, handed back to Spark at once
_ROWS = 1 << 15


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner = label, {}, None


def _agreement(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of the label the text has from ``at`` on; the first one it has."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Byte strings on compressed edges; ``terminal`` finds or makes the node at which one ends."""

    def __init__(self):
        self.root = Node(b"")
        self.sizes: dict[int, int] = {}  # by first byte
        self.held = 0

    def terminal(self, text: bytes) -> Node:
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text[at:])
                node.children[text[at]] = leaf
                self._grown(text[0], len(leaf.label) + _NODE)
                return leaf
            label = child.label
            if not text.startswith(label, at):
                k = _agreement(label, text, at)
                fork = Node(label[:k])
                child.label = label[k:]
                fork.children[label[k]] = child
                node.children[text[at]] = child = fork
                self._grown(text[0], _NODE)
                at += k
            else:
                at += len(label)
            node = child
        return node

    def _grown(self, first: int, size: int) -> None:
        self.sizes[first] = self.sizes.get(first, 0) + size
        self.held += size

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Takes the largest subtree below the root out: its strings with their owners."""
        first = max(self.sizes, key=self.sizes.__getitem__)
        self.held -= self.sizes.pop(first)
        yield from _terminals(self.root.children.pop(first))

    def rest(self) -> Iterator[tuple[bytes, object]]:
        """Takes all strings out, the empty one too."""
        if self.root.owner is not None:
            yield b"", self.root.owner
            self.root.owner = None
        while self.sizes:
            yield from self.spill()


def _terminals(top: Node) -> Iterator[tuple[bytes, object]]:
    waiting = [(b"", top)]
    while waiting:
        before, node = waiting.pop()
        text = before + node.label
        if node.owner is not None:
            yield text, node.owner
        waiting.extend((text, child) for child in node.children.values())


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size_at: int) -> Iterator[pa.RecordBatch]:
    """The rows as batches of bounded bytes; ``size_at`` is the column whose length counts."""
    waiting: list[tuple] = []
    size = 0
    for row in rows:
        waiting.append(row)
        size += len(row[size_at] or b"")
        if size >= _OUT or len(waiting) >= _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds, strict=True)], names)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds, strict=True)], names)


_STRINGS = (
    "task bigint, node bigint, row_no bigint, doc_id bigint, sha256 binary, "
    "n_bytes bigint, content_hash bigint, text binary, owner bigint, owner_row bigint, n bigint"
)
_STRING_NAMES = [c.split()[0] for c in _STRINGS.split(", ")]
_STRING_KINDS = [pa.binary() if c.endswith("binary") else pa.int64() for c in _STRINGS.split(", ")]


def _rank(doc_id: int | None, sign: int) -> tuple[bool, int]:
    return doc_id is None, 0 if doc_id is None else sign * doc_id


def _strings(docs: DataFrame, sign: int, budget: int) -> DataFrame:
    """Two kinds of rows: each document with the node of its text, and each node with its string and owner.

    A node is told by its task and a number; ``row_no`` tells rows of one task apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task = int.from_bytes(os.urandom(8), "big") >> 1
        trie = Trie()
        node_no = row_no = 0

        def out(strings: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
            for text, (node, sha, _, doc_id, owner_row, n) in strings:
                content_hash = int.from_bytes(sha[:8], "big", signed=True)
                yield task, node, None, None, None, len(text), content_hash, text, doc_id, owner_row, n

        for batch in W.sliced(batches, "text"):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = (text or "").encode().lower()
                end, rank = trie.terminal(data), _rank(doc_id, sign)
                owner = end.owner
                if owner is None:
                    owner = end.owner = [node_no, hashlib.sha256(data).digest(), rank, doc_id, row_no, 0]
                    node_no += 1
                elif rank < owner[2]:
                    owner[2:5] = rank, doc_id, row_no
                owner[5] += 1
                yield task, owner[0], row_no, doc_id, owner[1], *[None] * 6
                row_no += 1
                while trie.held > budget:
                    yield from out(trie.spill())
        yield from out(trie.rest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _STRING_NAMES, _STRING_KINDS, _STRING_NAMES.index("text"))

    return docs.select("doc_id", "text").mapInArrow(run, _STRINGS)


_OWNERS = "task bigint, node bigint, owner bigint, owner_task bigint, owner_row bigint, group_size bigint"


def _owners(strings: DataFrame, sign: int, budget: int) -> DataFrame:
    """The owner of all equal strings for each node; of equal identifiers that of the smallest task and row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, key = Trie(), None

        def out(strings: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
            for _, (best, size, nodes) in strings:
                (_, owner_task, owner_row), owner = best
                for task, node in nodes:
                    yield task, node, owner, owner_task, owner_row, size

        columns = ("n_bytes", "content_hash", "text", "task", "node", "owner", "owner_row", "n")
        for batch in W.sliced(batches, "text"):
            for n_bytes, content_hash, text, task, node, doc_id, owner_row, n in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if (n_bytes, content_hash) != key:
                    key = n_bytes, content_hash
                    while trie.held > budget:  # what it holds has all been of earlier keys
                        yield from out(trie.spill())
                end = trie.terminal(text)
                mine = ((_rank(doc_id, sign), task, owner_row), doc_id)
                if end.owner is None:
                    end.owner = [mine, 0, []]
                elif mine[0] < end.owner[0][0]:
                    end.owner[0] = mine
                end.owner[1] += n
                end.owner[2].append((task, node))
        yield from out(trie.rest())

    names = [c.split()[0] for c in _OWNERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = ((*row, b"") for row in rows(batches))
        for batch in _batches(sized, [*names, "none"], [*[pa.int64()] * 6, pa.binary()], 6):
            yield batch.select(names)

    key = ("n_bytes", "content_hash")
    return strings.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, _OWNERS)


def exact_duplicates(docs: DataFrame, keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs(doc_id, text)``.

    Of equal texts the row of the ``smallest`` or the ``largest`` doc_id stays, one without id only
    where no row of the group has one; of rows that tie one stays, any of them. A repeated row
    counts as often as it is there. A null text is equal to an empty one. No rows: none. Other columns are not
    looked at. Memory: a trie's budget and one text; in the second pass also the texts of one
    length and 64-bit hash, and two numbers for each task that has a string of theirs.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    sign = 1 if keep == "smallest" else -1
    found = stored(_strings(docs, sign, budget))
    members = found.where("row_no is not null").select("task", "node", "row_no", "doc_id", "sha256")
    strings = found.where("row_no is null").select("n_bytes", "content_hash", "text", "task", "node", "owner", "owner_row", "n")
    joined = members.join(_owners(strings, sign, budget), ["task", "node"])
    return joined.select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        "group_size",
        ((F.col("task") == F.col("owner_task")) & (F.col("row_no") == F.col("owner_row"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )
