import numpy as np
import pytest

from rateloom.llm import toxicity as tx

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def test_label_model_recovers_accuracies_and_a_correlated_pair():
    rng = np.random.default_rng(1)
    n = 60_000
    y = rng.random(n) < 0.2
    hit = np.where(y, 0.8, 0.05)
    votes = rng.random((n, 16)) < hit[:, None]
    votes[:, 1] = votes[:, 0] ^ (rng.random(n) < 0.02)  # sees what the first sees
    bits = votes.astype(int) @ (1 << np.arange(16))
    labels = [(int(b), int(t), 1) for b, t in zip(bits[:2000], y[:2000])]
    rest, counts = np.unique(bits[2000:], return_counts=True)
    model = tx.fit_label_model(labels + [(int(b), None, int(c)) for b, c in zip(rest, counts)])
    off, on = model.accuracies()
    assert np.abs(on - 0.8).max() < 0.06 and np.abs(off - 0.05).max() < 0.03
    assert (0, 1) in model.pairs and model.weights[model.pairs.index((0, 1))] > 1
    # the twins together count for little more than a single voter
    alone, twins, two = model.posterior(np.array([1, 3, 5]))
    assert twins < two


def test_votes_of_a_text():
    lexicon = {"bad": 0, "lou*": 1}
    assert tx.spotted("A BAD day, loudly", lexicon) == [0, 1]
    assert tx.spotted("x x x x x x", lexicon) == [5]
    assert tx.spotted(None, lexicon) == [] and tx.vote_bits([0, 1, 5], 2) == 0b1000000000000011


@pytest.mark.parametrize("sf,least", [("sf0.1", 0.75)])
def test_held_out_texts(spark, sf, least):
    found = tx.op3_toxicity(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    tp = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert tp / found.toxic.sum() > least and tp / found.predicted.sum() > 0.95


def test_labels_of_held_out_documents_are_not_learned(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tx.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, tx.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_awkward_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "w " * 30000, "x", "y", 1), (4, "bad", "x", "y", 1), (4, "bad", "x", "y", 1), (None, "a b", "x", None, 1)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS toxic", "0.5 AS score")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 0), (4, 1), (4, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    found = tx.toxicity(docs, labels).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    none = tx.toxicity(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert tx.toxicity(docs.limit(0), labels).count() == 0
