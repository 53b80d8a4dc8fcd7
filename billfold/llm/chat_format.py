"""Chat formatting with a template that is only rendered, never looked into.

Successive prefixes of a conversation are rendered and compared: where each output begins with
the one before, what is added is the new turn's span. The turn rendered once more with a marker
as its text shows where in the span the text lies. A template whose output does not
begin with the one before rewrites history.

All prefixes are rendered whole, so the work grows with the square of a conversation. A template that
renders each turn by itself can say so (``local``): then the few turns before stand for the prefix, which is
checked on every turn, and a conversation is formatted a segment at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[Sequence[Turn]], str]

ASSISTANT = "assistant"
SEGMENT = 256  # turns in one row of output
CONTEXT = 8  # turns before the newest that stand for the prefix of a local template, beside the conversation's first
MARKERS = range(0xE000, 0xF900)  # code points of which one that the turn does not hold marks its text

_CONTROL = re.compile(r"([<\[])(?=/?(?:s>|INST\]))")
_TURN = re.compile(r"(?:<s>|\[INST\])(.*?)\n(.*?)(?:</s>|\[/INST\])", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left: each backslash doubled, one put after the bracket that opens such a string."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(escaped: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], escaped)


def inst_template(turns: Sequence[Turn]) -> str:
    """``<s>role, line end, text</s>`` for the assistant, the same in ``[INST]`` and ``[/INST]`` for others."""
    out = []
    for role, text in turns:
        opened, closed = ("<s>", "</s>") if role == ASSISTANT else ("[INST]", "[/INST]")
        name = escape(role).replace("\n", "\\n")
        out.append(f"{opened}{name}\n{escape(text)}{closed}")
    return "".join(out)


inst_template.local = True


def _placed(old: str, before: list[Turn], turn: Turn, template: Template) -> tuple[str, int, int] | None:
    """The output with one turn more, and how much of the new span lies before and behind the turn's text.

    None if the output does not begin with ``old``, or no marker is found once in the span.
    """
    new = template([*before, turn])
    if not new.startswith(old):
        return None
    for marker in map(chr, MARKERS):
        probe = template([*before, (turn[0], marker)])
        if probe.count(marker, len(old)) == 1:
            break
    else:
        return None
    head = probe.find(marker, len(old)) - len(old)
    tail = len(probe) - len(old) - head - 1
    if not probe.startswith(old) or new[len(old) : len(old) + head] != probe[len(old) : len(old) + head]:
        return None
    return new, head, tail


def spans(turns: Sequence[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The rendered turns, and of each turn where it and its text begin and end; None if history is rewritten.

    Every prefix is rendered as it is.
    """
    out, old = [], ""
    for i, turn in enumerate(turns):
        found = _placed(old, list(turns[:i]), turn, template)
        if found is None:
            return template(turns), None
        new, head, tail = found
        out.append((len(old), len(new), len(old) + head, len(new) - tail))
        old = new
    return old if turns else template(turns), out


def local_spans(
    before: Sequence[Turn], turns: Sequence[Turn], template: Template
) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The same for turns that follow ``before``, of a template that says it is local; places count from the first of ``turns``.

    None also if what it says is wrong: if the output of all these turns is not their spans in a row.
    """
    known = list(before)
    start = len(template(known)) if known else 0
    whole = template([*known, *turns])[start:]
    out, at = [], 0
    for turn in turns:
        few = known if len(known) <= CONTEXT + 1 else [known[0], *known[-CONTEXT:]]
        old = template(few) if few else ""
        found = _placed(old, few, turn, template)
        if found is None:
            return whole, None
        new, head, tail = found
        size = len(new) - len(old)
        if not whole.startswith(new[len(old) :], at):
            return whole, None
        out.append((at, at + size, at + head, at + size - tail))
        at += size
        known = [*few, turn]
    return whole, out if at == len(whole) else None


def formatted(turns: DataFrame, template: Template = inst_template, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, segment, n_turns, text, spans, rewrites)``, the segments of a conversation in order.

    ``turns(conv_id, turn, role, text)`` are taken by turn (null first), equal turns by role and text;
    null roles and texts are empty. A conversation without id is one of its own. The texts of a conversation's segments
    joined are what the template makes of all its turns; ``spans`` holds ``(start, end, text_start, text_end, loss)`` of
    each turn, from its segment's beginning. Where the template rewrites history, a conversation is one row, ``rewrites``
    is true and ``spans`` null. A conversation's rows pass through one task in order, as its
    digest needs: of a local template ``segment`` turns are held at once (a segment that does not bear out that it is
    local has ``rewrites`` true), of others the conversation. Other columns are not looked at.
    """
    place = pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_())])
    names = ["conv_id", "segment", "n_turns", "text", "spans", "rewrites"]
    local = getattr(template, "local", False)

    def row(conv_id: int | None, number: int, held: list[Turn], text: str, found: list | None) -> pa.RecordBatch:
        told = found and [
            dict(start=a, end=b, text_start=c, text_end=d, loss=role == ASSISTANT) for (a, b, c, d), (role, _) in zip(found, held, strict=True)
        ]
        columns = zip((conv_id, number, len(held), text, told, found is None), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(place), pa.bool_()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in columns], names)

    def whole(conv_id: int | None, held: list[Turn]) -> Iterator[pa.RecordBatch]:
        text, found = spans(held, template)
        if found is None:
            yield row(conv_id, 0, held, text, None)
            return
        for number, begin in enumerate(range(0, len(held), segment)):
            part = found[begin : begin + segment]
            at = part[0][0]
            moved = [tuple(x - at for x in places) for places in part]
            yield row(conv_id, number, held[begin : begin + segment], text[at : part[-1][1]], moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Turn] = []
        before: list[Turn] = []
        current, number = None, 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held and (conv_id != current or (local and len(held) == segment)):
                    if local:
                        yield row(current, number, held, *local_spans(before, held, template))
                    else:
                        yield from whole(current, held)
                    turns_so_far = [*before, *held]
                    before, number = ([turns_so_far[0], *turns_so_far[1:][-CONTEXT:]], number + 1) if conv_id == current else ([], 0)
                    held = []
                current = conv_id
                held.append((role, text))
        if held and local:
            yield row(current, number, held, *local_spans(before, held, template))
        elif held:
            yield from whole(current, held)

    clean = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = (
        "conv_id bigint, segment bigint, n_turns bigint, text string, spans array<struct<start: bigint, end: bigint, "
        "text_start: bigint, text_end: bigint, loss: boolean>>, rewrites boolean"
    )
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation, all of it read from the formatted texts of ``inst_template`` and their spans.

    ``segments`` must come in the order ``formatted`` gives them. ``(conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars)``; digests are fed segment by segment.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def ended(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or not r["segment"]:
                    if state is not None:
                        done.append(ended(state))
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["text"]
                for role, body in _TURN.findall(text):
                    state[1] += 1
                    state[2].update(f"{_role(role)}\n{unescape(body)}\n".encode())
                for span in r["spans"] or ():
                    if span["loss"]:
                        learned = unescape(text[span["text_start"] : span["text_end"]])
                        state[3] += len(learned)
                        state[4].update(learned.encode())
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(ended(state), kinds, strict=True)], names)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return segments.mapInArrow(run, schema)
