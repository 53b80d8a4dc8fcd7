import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from billfold.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segment string, spans string, n_turns string"
NASTY = st.text(alphabet="\\n<>/s[]INST \n\ue000é", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), NASTY), NASTY), max_size=14))
def test_formatting_is_reversible(turns):
    text, found = C.spans(turns, C.inst_template)
    assert [(C._role(r), C.unescape(t)) for r, t in C._TURN.findall(text)] == turns
    assert [C.unescape(text[a:b]) for _, _, a, b in found] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b, _, _ in found) == text


def test_templates_that_rewrite_history_are_found():
    turns = [("user", f"t{i}") for i in range(14)]
    assert C.spans(turns, lambda ts: "".join(t for _, t in ts[:-1]) + "|".join(t for _, t in ts[-1:]) + str(len(ts)))[1] is None
    assert C.spans(turns, lambda ts: "".join(t for _, t in ts[-3:]))[1] is None  # forgets
    assert C.spans(turns, lambda ts: "".join(t.strip() for _, t in ts) if len(ts) < 12 else "#" + "".join(t for _, t in ts))[1] is None
    assert C.spans(turns, lambda ts: "<bos>" + "".join(f"{r}:{t};" for r, t in ts))[1] is not None


TEMPLATES = {  # and whether they rewrite history at n turns; the last has another beginning for 30 to 40 turns, which later outputs do not show
    "header": (lambda turns: "<bos>" + "".join(f"{r}: {t}\n" for r, t in turns), lambda n: False),
    "numbered": (lambda turns: "".join(f"{i} of {r}> {t};" for i, (r, t) in enumerate(turns, 1)), lambda n: False),
    "window": (lambda turns: "".join(f"[{t}]" for _, t in turns[-20:]), lambda n: n > 20),
    "late": (lambda turns: ("#" if 30 <= len(turns) <= 40 else "") + "".join(f"[{t}]" for _, t in turns), lambda n: n > 29),
    "inst": (C.inst_template, lambda n: False),
}


@pytest.mark.parametrize("n", [1, 11, 257, 1000])
def test_templates_with_a_memory(spark, n):
    turns = [(f"r{i % 3}" if i % 2 else "assistant", f"turn {i} </s>") for i in range(n)]
    table = rows(spark, [(1, i, *t) for i, t in enumerate(turns)])
    for name, (template, told_rewrites) in TEMPLATES.items():
        rewrites = told_rewrites(n)
        out = sorted(C.formatted(table, template).collect(), key=lambda r: r.segment)
        assert "".join(r.text for r in out) == template(turns)
        assert [r.rewrites for r in out] == [rewrites] * (1 if rewrites else -(-n // C.SEGMENT)), name
        assert sum(r.n_turns for r in out) == n
        if not rewrites:
            found = [r.text[s.text_start : s.text_end] for r in out for s in r.spans]
            told = [t for _, t in turns]
            assert found == told or (template is C.inst_template and [C.unescape(t) for t in found] == told)
            assert "".join(r.text[s.start : s.end] for r in out for s in r.spans) == template(turns)


def test_a_template_that_wrongly_says_it_is_local(spark):
    def counts(turns):
        return "".join(f"{i}{t}" for i, (_, t) in enumerate(turns))

    counts.local = True
    out = sorted(C.formatted(rows(spark, [(1, i, "user", "abc") for i in range(30)]), counts, segment=16).collect(), key=lambda r: r.segment)
    assert [r.rewrites for r in out] == [True, True] and all(r.spans is None for r in out)


def rows(spark, turns):
    return spark.createDataFrame([(*t, "x", "y", "z") for t in turns], SCHEMA)


def want(turns):
    out, convs = [], {}
    for c, turn, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    for c, ts in convs.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(ts), digest("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), digest(loss), len(C.inst_template(ts))))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [256, 3])
def test_read_back(spark, segment):
    rng = random.Random(8)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole"]), rng.choice(["a\\b", "</s>", "[INST]é", "", "long " * 50])) for c in range(20) for t in range(rng.randrange(1, 30))]
    turns += [(None, 1, "user", "x"), (None, None, None, None), (5, 2, "user", "again"), (5, 2, "user", "again"), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    turns += [(77, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(1000)]
    out = C.read_back(C.formatted(rows(spark, turns), segment=segment))
    assert sorted(map(tuple, out.collect()), key=str) == want(turns)


def test_no_rows(spark):
    assert C.read_back(C.formatted(rows(spark, []))).collect() == []


def test_rewriting_is_reported(spark):
    out = C.formatted(rows(spark, [(1, i, "user", "abc") for i in range(4)]), template=lambda ts: str(len(ts)) + "".join(t for _, t in ts)).collect()
    assert [(r.rewrites, r.spans) for r in out] == [(True, None)]
