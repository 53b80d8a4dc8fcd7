import html
import itertools
import math
import random
import time

import numpy as np
import pytest
from conftest import prose

from billfold.llm import html_extraction as H
from billfold.llm.html_extraction import BINS, DEPTH, RATE, Tree, boost, decode, parse

SCHEMA = "page_id bigint, url string, html string, text string, n_chars int"


def sentence(seed):
    return prose(seed, 40).capitalize().replace(" w1", ", w1") + "."


def page(seed, shape):
    """A page and its main text: an article element, or none; what stands beside it says so or not."""
    rng = random.Random(seed)
    blocks = [f"Title {seed} & more", *(sentence(seed * 50 + i) for i in range(rng.randrange(2, 9)))]
    told = [html.escape(b) for b in blocks]
    if shape == "article":
        mark = "".join(f"<p>{b}" if seed % 2 else f"<p>{b}</p>\n" for b in told[1:])
        inner = f"<article><h1>{told[0]}</h1>{mark}<div class='ad'>Buy this</div><section class='reader-comments'><p>{sentence(9)}</p></section></article>"
    else:
        inner = f"<div class='post-content'><h1>{told[0]}</h1>" + "".join(f"<p>{b}</p>" for b in told[1:]) + "<form><label>Mail</label></form></div>"
    menu = "".join(f"<li><a href='/{i}'>menu {i}</a>" for i in range(6))
    return (
        f"<!DOCTYPE html><html><head><title>{told[0]}</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>"
        f"<nav><ul>{menu}</ul></nav><!-- <p>gone</p> -->{inner}<div id='sidebar'><p>{sentence(8)}</p></div>"
        f"<div class='cookie-notice'>We use cookies.</div><footer>&copy; {seed} &middot; all</footer></body></html>",
        "\n".join(blocks),
    )


@pytest.fixture(scope="module")
def model(spark):
    pages = [(i, "u", page(i, "article" if i % 3 else "div")[0], "x", 1) for i in range(60)]
    return H.fit(spark.createDataFrame(pages, SCHEMA))


def test_held_out_pages(spark, model):
    made = {i: page(i, "article" if i % 2 else "div") for i in range(1000, 1060)}
    out = H.extracted(spark.createDataFrame([(i, "u", p[0], "x", 1) for i, p in made.items()], SCHEMA), model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    for r in out.collect():
        assert r.text == made[r.page_id][1] and r.n_chars == len(r.text)


def test_odd_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>"), (4, "u", "just text, no markup at all"), (4, "u", "just text, no markup at all"),
            (5, "u", "<div>" * 5000 + sentence(1)), (6, "u", "<" * 2000 + "a <b' \"> < c"), (7, "u", "<script>never ended " + "x" * 10**6)]
    out = H.extracted(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), model)
    got = sorted(((r.page_id, r.text) for r in out.collect()), key=str)
    assert len(got) == len(rows) and all(t == "" for i, t in got if i in (1, 2, None, 7))
    empty = spark.createDataFrame([], SCHEMA)
    assert H.extracted(empty, H.fit(empty)).collect() == []


def test_parsing_of_broken_markup():
    tree = H.parse("a<p>b <b>c<p>d<br>e &amp;&nbsp;f &am</b><ul><li>g<li>h<a href='>'>i</a></ul><td>j</P>k<img alt=\"<p>\">l<3 m")
    assert [(tree.tags[n], t) for n, t, _ in tree.runs] == [
        ("#root", "a"), ("p", "b c"), ("p", "d e & f &am"), ("li", "g"), ("li", "hi"), ("td", "j"), ("td", "kl<3 m"),
    ]
    assert [w for _, _, w in tree.runs] == [0, 0, 0, 0, 1, 0, 0]


def test_no_text_below_what_is_none():
    tree = H.parse("<div><p>a b</p><div><p>c d</p></div></div><div><p>e f</p></div>")
    at = {t: n for n, t, _ in tree.runs}
    score = [-5.0] * len(tree.tags)
    score[at["a b"]], score[at["e f"]] = 1.0, 2.0
    kept = H.decode(tree, __import__("numpy").array(score))
    for n in range(1, len(tree.tags)):
        assert kept[tree.parents[n]] or not kept[n]
    assert kept[at["a b"]] and kept[at["e f"]] and not kept[at["c d"]]


def test_odd_raw_elements_do_not_swallow_the_text():
    from billfold.llm.html_extraction import parse

    def said(page):
        return " ".join(text for _, text, _ in parse(page).runs).split()

    for opening in ('<svg width="9"/>', "<math/>", "<object data='x'>", "<noscript>", "<iframe>", "<template>", "<svg>", "<textarea>"):
        assert said(f"<article><p>one</p>{opening}<p>two</p></article><p>three") == ["one", "two", "three"], opening
    for tag in ("template", "svg"):
        assert said(f"<p>one<{tag}>a<{tag}>b</{tag}>c</{tag}><p>two") == ["one", "two"]
    assert said("<p>one<object>a<object>b</object>c</object><p>two") == ["one", "a", "b", "c", "two"]
    assert said("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == "where x=2 holds".split()
    assert said("<p>one<noscript>two</noscript>") == ["one", "two"]
    assert said("<p>one<script>if (a < b) {") == said("<p>one<style>p {") == ["one"]


def test_time_follows_the_length_of_broken_pages():
    n = 100_000
    pages = {
        "single quotes": "<p>" + "<a '" * n,
        "double quotes": "<p>" + '<a "' * n + ">",
        "values never closed": "<p>text</p>" + "<a x='>'" * n,
        "unclosed declarations": "</" * n,
        "nested blocks": "<div>" * n + "deep",
        "nested inline": "<b>" * n + "bold" + "</i>" * n,
        "items": "<ul>" + "<li><div>" * n,
        "signs": "<" * 10_000_000,
    }
    for name, page in pages.items():
        start = time.process_time()
        tree = parse(page)
        assert time.process_time() - start < 2 + 2 * len(page) / 1e6, name
        assert tree.runs or "quotes" in name or name in ("items", "values never closed"), name
    assert [t for _, t, _ in parse(pages["nested inline"]).runs] == ["bold"]


def test_tags_with_odd_quotes_and_signs():
    cases = {
        "<p title='a > b'>x</p>": ["x"],
        '<p title="a > b" class=k>x</p>y': ["x", "y"],
        "<p it's>x</p>": ["x"],
        "<p a='unclosed>x</p>": ["x"],
        "<div <p>x</p>": ["x"],
        "1 < 2 <b>and</b> 3 > 2": ["1 < 2 and 3 > 2"],
        "x <!-- never closed <p>y": ["x"],
        "a<br/>b<hr/>c": ["a b", "c"],
    }
    for page, want in cases.items():
        assert [t for _, t, _ in parse(page).runs] == want, page


def test_decoding_against_all_labellings():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randrange(2, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        runs = [(rng.randrange(n), "w " * rng.randrange(1, 6) + "w", 0) for _ in range(rng.randrange(8))]
        tree = Tree(["div"] * n, parents, [0] * n, [0] * n, runs)
        score = np.array([rng.gauss(0, 2) for _ in range(n)])
        words = [sum(t.count(" ") + 1 for at, t, _ in runs if at == i) for i in range(n)]
        worth = [score[i] * np.log1p(words[i]) for i in range(n)]

        def value(labels, worth=worth):
            return sum(w if x else -w for w, x in zip(worth, labels, strict=True))

        allowed = [x for x in itertools.product((False, True), repeat=n) if x[0] and all(x[parents[i]] or not x[i] for i in range(1, n))]
        got = decode(tree, score)
        assert tuple(got) in allowed and abs(value(got) - max(map(value, allowed))) < 1e-9


def test_boosting_against_plain_loops():
    """Every split of every tree found by trying all cuts of all features on the rows of its node."""
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(120, 4)), 1).astype(np.float32)
    labels = ((rows[:, 0] > 0.2) ^ (rows[:, 2] > 0.5)).astype(float)
    model = boost(rows, labels, trees=3)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(4)]
    share = labels.mean()
    weight = [0.5 / share if y else 0.5 / (1 - share) for y in labels]
    score = [0.0] * len(rows)
    for _ in range(3):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [w * (y - q) for w, y, q in zip(weight, labels, p, strict=True)]
        h = [w * max(q * (1 - q), 1e-6) for w, q in zip(weight, p, strict=True)]

        def part(members, g=g, h=h):
            return sum(g[i] for i in members) ** 2 / (sum(h[i] for i in members) + 1)

        nodes = [list(range(len(rows)))]
        for _ in range(DEPTH):
            below = []
            for members in nodes:
                best, split = 0.0, (members, [])
                for f in range(4):
                    for c in cuts[f]:
                        low, high = [i for i in members if rows[i, f] <= c], [i for i in members if rows[i, f] > c]
                        gain = part(low) + part(high) - part(members)
                        if gain > best + 1e-7:
                            best, split = gain, (low, high)
                below += split
            nodes = below
        for members in nodes:
            if members:
                step = RATE * sum(g[i] for i in members) / (sum(h[i] for i in members) + 1)
                for i in members:
                    score[i] += step
    assert np.allclose(model(rows), score, atol=1e-6)
