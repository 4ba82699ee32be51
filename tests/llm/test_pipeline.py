import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from rateloom.llm import decontam, mixing, simhash, toxicity
from rateloom.session import table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark):
    out, docs = [], table(spark, SF, "documents")
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, SF), "test_stage")
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(staged):
    assert [d.columns for d in staged[:-1]] == [COLUMNS] * 4


def test_toxicity_drops_what_it_predicts(spark, staged):
    docs = table(spark, SF, "documents")
    found = toxicity.toxicity(docs, table(spark, SF, "labels")).where("predicted = 0")
    assert ids(staged[0]) == ids(found) and staged[0].count() < docs.count()


def test_one_of_each_group_stays(spark, staged):
    rows, found = simhash.similar(staged[0])
    assert ids(staged[1]) == {r["component_id"] for r in found.select("component_id").collect()}
    assert staged[1].count() == len(ids(staged[1])) < staged[0].count()


def test_no_window_of_the_benchmark_is_left(spark, staged):
    hit = decontam.contamination(staged[1], table(spark, SF, "benchmark")).where("size(hits) > 0")
    assert ids(hit) and ids(staged[2]) == ids(staged[1]) - ids(hit)


def test_the_mix_takes_its_words(staged):
    plan = {r["doc_id"]: r for r in mixing.mixed(staged[2]).collect()}
    taken, rows = defaultdict(int), staged[3].collect()
    for r in rows:
        taken[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v["taken"] for k, v in plan.items() if v["taken"]} == dict(taken)


def test_shards_hold_every_row(spark, staged):
    rows = staged[4].collect()
    assert len(rows) == staged[3].count()
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(load) == 8 and max(load.values()) < 1.05 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {tuple(r) for r in cp.run(spark, SF).collect()} == {tuple(r) for r in rows}


def test_stages_bear_awkward_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "w " * 3000, "x", "y", 1), (4, "clean text here", "x", "y", 1), (4, "clean text here", "x", "y", 1), (None, "a b", "x", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).selectExpr("*", "1 AS node", "2 AS hits", "3 AS score")):
        for _, stage in cp.STAGES:
            docs = cp.materialize(stage(spark, docs, SF), "test_stage")
        docs.count()


def test_stages_bear_clashing_names_and_any_type(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "w " * 3000, "x", "y", 1), (4, "clean text here", "x", "y", 1), (4, "clean text here", "x", "y", 1), (None, "a b", "x", None, 1), (9, "one two", "x", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "size range begin target _text h spans row words d k node _node keep_id _hit hit hits _score score first text_key taken copies id".split()
    docs = docs.selectExpr("*", *(f"{k} AS `{c}`" for k, c in enumerate(names)), "map('a', doc_id) AS m", "array(text) AS l", "1.5 AS `with.dot`")
    docs = docs.withColumnRenamed("with.dot", "with_dot")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, cp.materialize(stage(spark, docs, SF), "test_stage")
        assert docs.columns == before.columns, name
        for r in docs.collect():
            assert [r[c] for c in names] == list(range(len(names)))
            assert r["m"] == {"a": r["doc_id"]}
    assert {r["doc_id"] for r in docs.collect()} >= {3, 4, 9}
    assert cp.shard(spark, docs, SF).count() == docs.count()
