import random
import re
from collections import Counter
from math import log

import pyarrow as pa
import pytest
from conftest import prose

from billfold.llm import decontamination as D


def brute(docs, items):
    """Documents with an item: BM25 of each passage written out, then shared runs of five words."""
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in items if t and t.split()}
    mean = sum(map(len, split.values())) / max(len(split), 1)
    df = Counter(w for ws in split.values() for w in set(ws))
    stride = max([64, *map(len, split.values())])

    def weight(word, ws):
        tf = ws.count(word)
        idf = log(1 + (len(split) - df[word] + 0.5) / (df[word] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))

    out = set()
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        for at in range(0, max(1, len(words) - stride), stride):
            passage = words[at : at + 2 * stride]
            for i, ws in split.items():
                score = sum(weight(w, ws) for w in set(ws) & set(passage)) / sum(weight(w, ws) for w in set(ws))
                n = min(5, len(ws))
                runs = {tuple(passage[j : j + n]) for j in range(len(passage) - n + 1)}
                hit = [any(tuple(ws[j : j + n]) in runs for j in range(max(0, p - n + 1), min(p, len(ws) - n) + 1)) for p in range(len(ws))]
                cut = len(ws) - min(len(ws), max(5, len(ws) // 4))
                question, answer = hit[:cut] or hit, hit[cut:]
                if score >= 0.5 and sum(question) >= 0.7 * len(question) and sum(answer) >= 0.5 * len(answer):
                    out.add((doc_id, i))
    return out


def found(spark, docs, items):
    out = D.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert out.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    return sorted(((r.doc_id, r.item_id) for r in out.collect()), key=str)


def planted():
    rng = random.Random(11)
    items = [(i, prose(100 + i, rng.randrange(6, 60), 3000)) for i in range(40)] + [(50, "short one"), (51, None), (52, " "), (53, "w1 w2 w3 w4 w5")]
    docs = []
    for d in range(60):
        words = prose(500 + d, rng.randrange(1, 700), 3000).split()
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(40)][1].split()
            if rng.random() < 0.4:
                item[rng.randrange(len(item))] = "changed"
            if rng.random() < 0.3:
                item = item[: len(item) // 2]
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else "\n".join(words)))
    return docs, items


def test_planted_items(spark, docs_of):
    docs, items = planted()
    want = brute(docs, items)
    assert len(want) > 20
    assert found(spark, docs_of(docs), items) == sorted(want, key=str)
    clean = D.decontaminated(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_shards_of_the_index_change_nothing(spark):
    docs, items = planted()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    texts = pa.array([t for _, t in docs])
    shards = list(D.indexes(table, shard_words=200))
    assert len(shards) > 3
    got = {(docs[row][0], ix.ids[item]) for ix in shards for row, item in D.hits(ix, texts, D.THRESHOLD, D.QUESTION, D.ANSWER)}
    assert got == brute(docs, items)


@pytest.mark.parametrize("items", [[], [(1, None), (2, "")]])
def test_no_items(spark, docs_of, items):
    docs = docs_of({1: "some text"})
    assert found(spark, docs, items) == []
    assert D.decontaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).count() == 1


def test_odd_rows(spark, docs_of, odd_rows):
    items = [(1, prose(2, 80)), (1, prose(2, 80)), (None, prose(3, 80))]
    assert set(found(spark, docs_of(odd_rows), items)) == {(None, 1), (5, 1), (5, None)}
    assert found(spark, docs_of([]), items) == []
