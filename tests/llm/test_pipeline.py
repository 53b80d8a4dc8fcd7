from collections import Counter

from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline as P

ITEM = prose(77, 40, 5000)


def rows():
    out = [(i, prose(1000 + i, 60 + i, 5000), "en", "a" if i % 3 else "b") for i in range(40)]
    out += [(100, out[3][1], "en", "a"), (101, out[3][1] + " x", "en", "b"), (3, out[3][1], "en", "a"), (None, out[4][1], "en", "a")]
    out += [(102, prose(5, 30, 5000) + "\n" + prose(6, 70, 5000), "en", "a"), (103, prose(7, 90, 5000) + "\n" + prose(6, 70, 5000), "en", "b")]
    out += [(104, prose(8, 50, 5000) + " " + ITEM + " " + prose(9, 50, 5000), "en", "a"), (105, None, "en", "a"), (106, "", None, None), (107, "123", "en", "a")]
    return out


def test_each_stage_takes_effect(spark, docs_of, tmp_path):
    docs = docs_of(rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames, held = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(held)
        assert held.columns[: len(docs.columns)] == docs.columns
    ids = [Counter(r.doc_id for r in f.collect()) for f in frames]
    every = Counter(r[0] for r in rows())
    assert every - ids[0] == Counter([105, 106, 107])
    assert ids[0] - ids[1] == Counter([100, 101, 3, None])
    assert ids[1] == ids[2] and ids[2] - ids[3] == Counter([104])
    texts = {r.doc_id: (r.text, r.n_chars) for r in frames[2].collect()}
    first, second = prose(7, 90, 5000), prose(5, 30, 5000) + "\n" + prose(6, 70, 5000)
    assert texts[102][0] == second and texts[103] == (first, len(first))
    mix = frames[4]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    assert mix.where((F.col("taken") != words) & (F.col("taken") != 2 * words)).count() == 0
    got = sorted(map(str, P.run(spark, str(tmp_path)).collect()))
    assert got == sorted(map(str, mix.collect()))


def test_no_documents(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_documents_without_an_id_are_not_lost(spark, docs_of):
    alone, twice, other = prose(301, 70, 5000), prose(302, 70, 5000), prose(303, 70, 5000)
    rows = [(None, alone), (None, twice), (None, twice + " x"), (None, other), (1, other), (2, prose(304, 70, 5000)), (2, prose(305, 70, 5000))]
    left = P.one_of_each(spark, docs_of(rows), "").collect()
    assert Counter(r.doc_id for r in left) == Counter({None: 2, 1: 1, 2: 2})
    texts = {r.text for r in left if r.doc_id is None}
    assert alone in texts and len(texts & {twice, twice + " x"}) == 1


def test_of_repeated_rows_one_stays_whatever_their_order(spark, docs_of):
    text = prose(400, 70, 5000)
    rows = [(1, text, "en", "z"), (1, text, "en", "a"), (1, text, None, "a"), (2, prose(401, 70, 5000), "en", "b")]
    left = []
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (1, 0, 3, 2)):
        docs = docs_of([rows[i] for i in order])
        left.append(sorted(map(str, P.one_of_each(spark, docs.repartition(3), "").collect())))
    assert left[0] == left[1] == left[2] and len(left[0]) == 2


def test_the_mix_has_names_of_its_own(spark, docs_of):
    docs = docs_of([(i, prose(500 + i, 20), "en", "ab"[i % 2]) for i in range(10)]).selectExpr("*", "'t' AS target", "1 AS __mix_size", "2 AS __sources")
    mix = P.to_target_weights(spark, docs, "")
    assert mix.columns == [*docs.columns, "__mix_size_", "source_size", "__mix_target", "taken"]
    assert {(r.size, r.target, r["__mix_size"], r["__sources"], r["__mix_size_"]) for r in mix.collect()} == {("size", "t", 1, 2, 20)}
