import random
import re

from conftest import prose

from billfold.llm.line_dedup import MIN_WORDS, cut, repeated_units, without_repeats

A, B, C = (prose(s, 60) for s in (1, 2, 3))
SHORT = "a line that stands in many places"


def spans(docs):
    return sorted((r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in repeated_units(docs).collect())


def test_later_passages_go_with_their_places(docs_of):
    texts = {4: f"{SHORT}\n{A}\ntail of four", 2: f"head é\n{A.upper()}", 9: f"{SHORT}\n{B}\n\n{B}", 5: f"{A}  \n{SHORT}"}
    docs = docs_of(texts)
    at = len(SHORT) + 1
    assert spans(docs) == [
        (4, at, at + len(A), 2, 7),
        (5, 0, len(A), 2, 7),
        (5, len(A) + 3, len(A) + 3 + len(SHORT), 4, 0),
        (9, at + len(B) + 2, at + 2 * len(B) + 2, 9, at),
    ]
    left = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(docs, length="n_chars").collect()}
    assert left[2][0] == texts[2] and left[4][0] == f"{SHORT}\ntail of four" and left[9][0] == f"{SHORT}\n{B}\n"
    assert 5 not in left and all(len(t) == n for t, n in left.values())


def test_lines_shorter_than_a_passage_stay_unless_they_follow_each_other(docs_of):
    lines = [prose(10 + i, 20) for i in range(4)]
    docs = docs_of({1: "\n".join(lines), 2: "\n".join([*lines[:3], "own"]), 3: "\n".join([lines[0], "own line", lines[1]])})
    assert {s[0] for s in spans(docs)} == {2} and len(spans(docs)) == 3


def brute_units(text):
    """(start, end, normalised words) of every unit, word by word."""
    out, line_start = [], 0
    for line in text.split("\n"):
        at, unit = 0, []
        for word in [w for w in re.split(r"([ \t\v\f\r]+)", line) if w]:
            if word.strip(" \t\v\f\r"):
                unit.append((line_start + at, line_start + at + len(word), word))
                if word[-1] in ".!?" or len(word.encode()) % 8 == 7:
                    out.append(unit)
                    unit = []
            at += len(word)
        out.append(unit)
        line_start += len(line) + 1
    lower = {c: c + 32 for c in range(65, 91)}
    return [(u[0][0], u[-1][1], tuple(w.translate(lower) for _, _, w in u)) for u in out if u]


def brute(rows):
    first, out = {}, set()
    for doc_id, text in sorted(rows):
        later = []
        for start, end, words in brute_units(text or ""):
            if words in first:
                later.append((start, end, len(words), *first[words]))
            else:
                first[words] = (doc_id, start)
                later.append(None)
        run = []
        for unit in [*later, None]:
            if unit:
                run.append(unit)
                continue
            total = sum(u[2] for u in run)
            out |= {(doc_id, u[0], u[1], u[2], total, u[3], u[4]) for u in run if total >= MIN_WORDS}
            run = []
    return out


def sentences(rng, n):
    words = ["Haus", "größte", "l'été", "besides", "walking", "a", "I", "yes?", "no!", "end.", "the", "of", "naïvely", "e.g.", "stop."]
    return " ".join(rng.choice(words) if rng.random() < 0.5 else f"w{rng.randrange(200)}" for _ in range(n))


def test_against_brute_force(docs_of):
    rng = random.Random(6)
    passages = [sentences(rng, rng.randrange(20, 90)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [sentences(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), sentences(rng, rng.randrange(30))]
        glue = rng.choice([" ", "\n", "  \t", "\n\n"])
        rows.append((i, glue.join(parts).upper() if i % 9 == 0 else glue.join(parts)))
    docs = docs_of(rows).repartition(4)
    names = ("doc_id", "start", "end", "n_words", "run_words", "kept_doc_id", "kept_start")
    got = [tuple(r[n] for n in names) for r in repeated_units(docs).collect()]
    want = brute([(i, t.translate({c: c + 32 for c in range(65, 91)})) for i, t in rows])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    spans = {}
    for i, start, end, *_ in sorted(want):
        spans.setdefault(i, []).append({"start": start, "end": end})
    left = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    for i, t in rows:
        assert left.get(i, "").split() == (cut(t, spans[i]) if i in spans else t).split()
        kept = "".join(c for k, c in enumerate(t) if not any(s["start"] <= k < s["end"] for s in spans.get(i, [])))
        assert left.get(i, "").split() == kept.split()  # only the units go, and no words run together


def test_a_glued_passage_with_an_edited_line_is_seen(docs_of):
    lines = [f"{prose(20 + i, 10)}. {prose(30 + i, 11)}? {prose(40 + i, 9)}!" for i in range(4)]
    edited = [*lines[:1], lines[1].replace("?", " and more?"), *lines[2:]]
    host = prose(50, 30)
    docs = docs_of({1: "\n".join(lines), 2: f"{host} {' '.join(edited)} {host[::-1]}"})
    gone = repeated_units(docs).collect()
    assert {r.doc_id for r in gone} == {2} and sum(r.n_words for r in gone) == 99
    text = next(r.text for r in without_repeats(docs).collect() if r.doc_id == 2)
    assert text.startswith(host) and text.endswith(host[::-1]) and "and more?" in text and not any(x in text for x in lines)


def test_columns_with_the_names_used_inside(docs_of, spark):
    docs = docs_of({1: A, 2: f"own words\n{A}"}).selectExpr("*", "doc_id * 2 AS __id", "'k' AS __KEY", "7 AS __spans")
    out = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert out[2].text == "own words" and [(r["__id"], r["__KEY"], r["__spans"]) for r in out.values()] == [(2, "k", 7), (4, "k", 7)]


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    assert [s[0] for s in spans(docs)] == [None]  # its text is that of 5, which ranks before a null id; (5, same) given twice stays
    out = without_repeats(docs, length="n_chars")
    assert out.columns == docs.columns and out.count() == len(odd_rows) - 1


def test_no_rows(docs_of):
    assert spans(docs_of([])) == [] and without_repeats(docs_of([])).count() == 0
