"""Main text of web pages: boosted trees over DOM-node features, decoded from the top of the tree down.

The nodes are a page's block elements. Their features are subtree text, link and tag density,
attribute tokens, depth and what their siblings are like. The trees are trained on a bounded sample of the
pages themselves: elements whose tag or attributes say what they are give the labels. Every node is
learned a second time with its tag and attributes hidden, so that density and siblings decide
where nothing is said, and as if it stood in an element beside the text, in and out of an article. A node is text or not; what is below a node that is not, is not either: the
labelling of highest total score under that rule is taken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billfold.llm import words as W

SAMPLE_PAGES = 400  # pages trained on at most, those of smallest hash
SAMPLE_NODES = 64  # of each such page
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.25

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture "
    "progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr "
    "annotation math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup "
    "msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes template svg".split())
NESTED = frozenset("template svg".split())  # of these the closing tag that belongs to the opening one counts
FOREIGN = frozenset("svg math mspace".split())  # closed by a slash in their opening tag
IN_HEAD = frozenset("base link meta title script style noscript template".split())
UNSEEN = frozenset("head select option datalist button audio video canvas map".split())
LISTED = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
LISTED |= {"thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
BESIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset address".split())
WRAPPERS = frozenset("form fieldset address".split())  # beside the text unless they hold it
OFTEN_TEXT = frozenset("author byline header meta tag tags top".split())  # with a word for text, no word against it
BESIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert author banner bio breadcrumb breadcrumbs byline byline captcha comment comments consent "
    "cookie cookies copyright dialog disclaimer disqus foot footer form gdpr header hero language login masthead menu meta modal nav "
    "navbar navigation newsletter notice notices notification pager pagination paywall popup print promo promoted promotion rating "
    "recommended register related replies reply respond search share sharing shop sidebar signup skip skyscraper social sponsor "
    "sponsored subscribe subscription tag tags teaser toc toolbar tooltip top topbar tracking widget widgets".split()
)
TEXT_TAGS = frozenset("article main".split())
TEXT_WORDS = frozenset("article articlebody blogpost body content entry main maincontent post postcontent story storybody text".split())

# A tag goes to its ">": values in quotes may hold one, a "<" outside of them belongs to the next tag. What cannot be read so
# goes to the next ">" whatever stands between. No run is given back once taken, so the time follows the length of the page.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARK = re.compile(r"[.,;:!?]")


@dataclass
class Tree:
    """Block elements in page order, the root first, and the runs of text between their borders."""

    tags: list[str]
    parents: list[int]
    beside: list[int]  # tokens of its attributes that speak against text
    inside: list[int]  # and for it
    runs: list[tuple[int, str, int]]  # node, text, words of it in links


def nested_ends(page: str, tag: str) -> dict[int, int]:
    """Where the element of each opening ``tag`` ends, by where it begins; those without a closing tag are absent."""
    ends, stack = {}, []
    for found in re.compile(rf"<!--.*?-->|<(/?){tag}\b[^>]*>", re.I | re.S).finditer(page):
        if found[1]:
            if stack:
                ends[stack.pop()] = found.end()
        elif found[1] is not None and not (tag in FOREIGN and found[0].endswith("/>")):
            stack.append(found.start())
    return ends


def parse(page: str) -> Tree:
    """The tree of a page however broken: open paragraphs and list items end where the next begins.

    A raw element without its closing tag is only its tag, but an open script or style goes on to the end.
    """
    tags, parents, beside, inside = ["#root"], [-1], [0], [0]
    runs: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = [("#root", 0)]  # tag and its block's node
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    blocks = [0]  # places of those that are not inline
    links, unseen, linked = 0, 0, 0
    pending: list[str] = []
    closed: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                runs.append((stack[-1][1], text, linked))
            pending.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, unseen
        if any(t not in INLINE for t, _ in stack[depth:]):
            flush()
        for t, _ in stack[depth:]:
            links -= t == "a"
            unseen -= t in UNSEEN
            places[t].pop()
            if t not in INLINE:
                blocks.pop()
        del stack[depth:]

    def enter(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def opened(wanted: str, border: tuple[str, ...]) -> int:
        """The place of the last open element of this tag, 0 if there is none behind the border."""
        depth = (places.get(wanted) or [0])[-1]
        return depth if all((places.get(b) or [0])[-1] <= depth for b in border) else 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            text = html.unescape(raw)
            pending.append(text)
            if links:
                linked += len(text.split())

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        found = _TOKEN.search(page, at) if at <= last else None
        if not found:
            rest = page[at:]
            say(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        say(page[at : found.start()])
        at = found.end()
        slash, name, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        tag = (name or "").lower()
        if not tag:
            continue
        if slash:
            if tag in INLINE:
                if (depth := opened(tag, ())) > blocks[-1]:
                    close(depth)
            elif depth := opened(tag, ()):
                close(depth)
            else:
                flush()
            continue
        if tag in FOREIGN and attributes.endswith("/"):
            continue
        if tag in RAW:
            if tag in NESTED:
                if tag not in closed:
                    closed[tag] = nested_ends(page, tag)
                at = closed[tag].get(found.start(), at)
            elif tag not in unclosed:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style"):
                    at = end
                else:
                    unclosed.add(tag)
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            if tag in ("hr",):
                flush()
            continue
        if tag in INLINE:
            enter(tag, stack[-1][1])
            links += tag == "a"
            continue
        flush()
        if tag not in IN_HEAD and (depth := opened("head", ())) and tag != "head":
            close(depth)
        if stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if tag in LISTED:
            for sibling in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                if depth := opened(sibling, LISTED[tag]):
                    close(depth)
        words = {w for m in _ATTRIBUTE.finditer(attributes) for w in _PART.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())}
        parents.append(stack[-1][1])
        tags.append(tag)
        inside.append(len(words & TEXT_WORDS))
        beside.append(len(words & (BESIDE_WORDS - OFTEN_TEXT if inside[-1] else BESIDE_WORDS)))
        enter(tag, len(tags) - 1)
        unseen += tag in UNSEEN
    flush()
    return Tree(tags, parents, beside, inside, runs)


_AGAINST, _IN_FAVOUR = 2, 5
SAID = 8  # features that tag and attributes give; the rest is density, place and siblings


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node, and 1 or 0 where tag and attributes tell what it is, else -1."""
    n = len(tree.tags)
    parent = np.array(tree.parents)
    words, linked, marks, blocks = (np.zeros(n) for _ in range(4))
    own = np.zeros(n)
    first = np.full(n, -1.0)
    seen = 0
    for node, text, in_links in tree.runs:
        count = text.count(" ") + 1
        own[node] += count
        linked[node] += in_links
        marks[node] += len(_MARK.findall(text))
        blocks[node] += 1
        if first[node] < 0:
            first[node] = seen
        seen += count
    words += own
    holds_text, holds_title = (np.isin(tree.tags, list(x)).astype(float) for x in (TEXT_TAGS, ("h1",)))
    below, children = np.ones(n), np.zeros(n)
    depth = np.zeros(n)
    against, in_favour = np.zeros(n), np.zeros(n)
    place, same = np.zeros(n), np.zeros(n)
    kinds: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p, tag = tree.parents[i], tree.tags[i]
        depth[i] = depth[p] + 1
        in_favour[i] = in_favour[p] + (tag in TEXT_TAGS) + (tree.inside[i] > 0 and tag != "body")
        place[i] = children[p]
        children[p] += 1
        kinds[p, tag] = kinds.get((p, tag), 0) + 1
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        for sums in (words, linked, marks, blocks, below, holds_text, holds_title):
            sums[p] += sums[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    for i in range(1, n):
        p, tag = tree.parents[i], tree.tags[i]
        same[i] = kinds[p, tag]
        wraps = holds_text[i] > 0 or (holds_title[i] > 0 and 2 * words[i] > seen)
        said = tag in BESIDE_TAGS - WRAPPERS or (not wraps and (tag in WRAPPERS or tree.beside[i] > 0))
        against[i] = against[p] + said
    up = np.maximum(parent, 0)
    some = np.maximum(words, 1)
    total = max(seen, 1)
    tag = np.array(tree.tags)
    columns = [
        np.isin(tag, list(BESIDE_TAGS)), np.array(tree.beside) > 0, against, np.isin(tag, list(TEXT_TAGS)),
        np.array(tree.inside) > 0, in_favour, np.char.startswith(tag, "h") & (np.char.str_len(tag) == 2),
        np.isin(tag, ["li", "ul", "ol", "td", "tr", "table", "dl", "dd", "dt"]),
        np.log1p(words), np.log1p(own), linked / some, marks / some, below / some, words / np.maximum(blocks, 1),
        words / total, np.maximum(first, 0) / total, (np.maximum(first, 0) + words) / total, depth, children,
        place / np.maximum(children[up], 1), same / np.maximum(children[up], 1), np.log1p(words[up] - words),
        words / np.maximum(words[up], 1), linked[up] / some[up],
    ]
    labels = np.where(against > 0, 0, np.where(in_favour > 0, 1, -1))
    if seen and not (labels[own > 0] == 1).any():
        dense = (own >= 20) & (linked < 0.3 * some) & (against == 0)
        labels = np.where(dense, 1, labels)
    labels[words == 0] = -1
    return np.stack(columns, axis=1).astype(np.float32), labels


@dataclass
class Boosted:
    """Trees of equal depth as arrays: the feature and the threshold of each inner node, the value of each leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic gradient boosting on binned features; both classes weigh the same."""
    n, width = rows.shape
    if not n:
        trees, rows = 0, np.zeros((1, width))  # no tree: nothing is text
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    score = np.zeros(n)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = Boosted(0.0, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (labels - p), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            base = 2**level - 1
            best = np.zeros(2**level)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cell = (node - base) * BINS + binned[:, f]
                gs, hs = (np.bincount(cell, x, 2**level * BINS).reshape(-1, BINS).cumsum(axis=1) for x in (g, h))
                whole_g, whole_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (whole_g - gs) ** 2 / (whole_h - hs + 1) - whole_g**2 / (whole_h + 1)
                gain = gain[:, : len(cuts[f])]
                at = gain.argmax(axis=1)
                value = gain[np.arange(len(gain)), at]
                for k in np.flatnonzero(value > best + 1e-9):
                    best[k] = value[k]
                    model.feature[t, base + k], model.threshold[t, base + k] = f, cuts[f][at[k]]
            node = 2 * node + 1 + (rows[np.arange(n), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        model.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        score += model.value[t][leaf]
    return model


def decode(tree: Tree, score: np.ndarray) -> np.ndarray:
    """Which nodes are text: the labelling of highest sum of scores without text below what is none."""
    n = len(tree.tags)
    bare = np.zeros(n)
    for node, text, _ in tree.runs:
        bare[node] += text.count(" ") + 1
    worth = score * np.log1p(bare)
    dropped, kept = -worth, worth.copy()
    for i in range(n - 1, 0, -1):
        dropped[tree.parents[i]] += dropped[i]
        kept[tree.parents[i]] += max(kept[i], dropped[i])
    is_text = np.zeros(n, bool)
    is_text[0] = True
    for i in range(1, n):
        is_text[i] = is_text[tree.parents[i]] and kept[i] > dropped[i]
    return is_text


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_nodes: int = SAMPLE_NODES) -> Boosted:
    """The trees of ``pages(page_id, html)``, from ``sample_pages`` pages and ``sample_nodes`` nodes of each at most."""
    width = len(features(parse(""))[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "html"):
            for page in batch["html"].to_pylist():
                rows, labels = features(parse(page))
                known = np.flatnonzero(labels >= 0)
                known = known[np.linspace(0, len(known) - 1, min(len(known), sample_nodes)).astype(int)] if len(known) else known
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[known].tobytes()], pa.binary()), pa.array([labels[known].astype(np.int8).tobytes()], pa.binary())], ["rows", "labels"]
                )

    order = F.xxhash64("page_id", "html")
    few = pages.where(F.col("html").isNotNull()).select("html", order.alias("o")).orderBy("o").limit(sample_pages)
    found = sorted(few.select("html").mapInArrow(run, "rows binary, labels binary").collect())
    rows = np.concatenate([np.zeros((0, width), np.float32), *(np.frombuffer(r.rows, np.float32).reshape(-1, width) for r in found)])
    labels = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r.labels, np.int8) for r in found)])
    hidden, beside = rows.copy(), rows.copy()
    hidden[:, :SAID] = 0
    beside[:, _AGAINST] += 1
    grafted = beside.copy()
    grafted[:, _IN_FAVOUR] += 1
    none = np.zeros(len(labels))
    return boost(np.vstack([rows, hidden, beside, grafted]), np.concatenate([labels, labels, none, none]).astype(float))


def extracted(pages: DataFrame, model: Boosted) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``, in one narrow pass.

    ``text`` joins the blocks that are text by line ends, white space inside a block as one blank;
    it is empty for a null or empty page and for one without text. Repeated rows are answered
    each, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "html"):
            trees = [parse(page or "") for page in batch["html"].to_pylist()]
            rows = [features(t)[0] for t in trees]
            scores = model(np.concatenate(rows))
            texts, at = [], 0
            for tree, own in zip(trees, rows, strict=True):
                is_text = decode(tree, scores[at : at + len(own)])
                at += len(own)
                texts.append("\n".join(text for node, text, _ in tree.runs if is_text[node]))
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = "page_id bigint, url string, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
