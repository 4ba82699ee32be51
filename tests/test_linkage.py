"""Average linkage without a matrix against the plain kernel: copies, ties, rows without a place, spaces of any size."""

import numpy as np
import pytest

from rateloom.functions import kernels
from rateloom.operators import linkage


def labels(spark, rows, k):
    df = spark.createDataFrame(rows, "k long, x array<double>").repartition(4)
    return [r["label"] for r in linkage.average_labels(df, "k", "x", k).orderBy("k").collect()]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(linkage, "DENSE", 12)
    monkeypatch.setattr(linkage, "NEAREST", 4)


def space():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 6)), rng.normal(3, 0.05, size=(60, 6)), rng.normal(-3, 1e-9, size=(40, 6))]) + 100
    return np.concatenate([x, x[:150], x[410:430], x[410:430]])[rng.permutation(690)]


@pytest.mark.parametrize("k", [2, 10, 90])
def test_groups_are_those_of_the_matrix(spark, small, k):
    x = space()
    got = labels(spark, [(i, v.tolist()) for i, v in enumerate(x)], k)
    assert got == kernels.linkage_labels(x, k).tolist()


def test_heights_are_those_of_the_matrix(spark, small):
    x = np.unique(space(), axis=0) - 100
    w = np.random.default_rng(1).integers(1, 4, len(x))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(kernels.linkage_merges(d, w)[0])
    got = np.sort(linkage.tree(x, w, linkage.searcher(spark, x, w), 12, 4)[0])
    assert len(got) == len(x) - 1 and np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_rows_without_a_place_have_no_label(spark):
    rows = [(0, [0.0, 1.0]), (1, None), (2, [0.0, 1.1]), (3, [5.0, float("inf")]), (4, [9.0, 1.0]), (5, [9.0, None]), (6, [-0.0, 1.0])]
    assert labels(spark, rows, 2) == [0, None, 0, None, 1, None, 0]
    assert labels(spark, rows, 5) == [0, None, 1, None, 2, None, 0]
    assert labels(spark, [], 2) == [] and labels(spark, [(1, None)], 2) == [None] and labels(spark, [(1, [4.0])], 2) == [0]


def test_equal_distances_end(spark, small):
    assert len(set(labels(spark, [(i, np.eye(40)[i].tolist()) for i in range(40)], 5))) == 5
    got = labels(spark, [(i, [float(i), 7.0]) for i in range(2000)], 8)
    assert len(set(got)) == 8 and got == sorted(got)


def test_a_space_too_large_for_its_matrix(spark):
    """40,000 vectors have 13 GB of distances."""
    df = spark.range(40_000).selectExpr("id AS k", "array(1000.0D * (id % 7), rand(5), rand(6)) AS x")
    got = linkage.average_labels(df, "k", "x", 7)
    assert got.where("label <> k % 7").count() == 0 and got.count() == 40_000
