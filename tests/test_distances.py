"""Block distances against plain ones: groups of several chunks, copies, null vectors, lengths and ties."""

import math
import random

import pytest

from rateloom.functions import kernels
from rateloom.operators import cluster


@pytest.fixture
def vectors(spark, monkeypatch):
    monkeypatch.setattr(cluster, "CHUNK", 7)
    rng = random.Random(4)
    rows = [(k, k % 3, [1e3 + rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(k % 3, 1)], float(k % 5 + 1)) for k in range(60)]
    rows += [(100 + k, 1, rows[0][2], 1.0) for k in range(9)] + [(200, 0, None, 1.0), (201, 0, [1.0, 2.0], 1.0), (202, 7, [5.0, 5.0, 5.0], None), (203, None, [0.0, 0.0, 0.0], 1.0)]
    return rows, spark.createDataFrame(rows, "k long, g int, x array<double>, w double").repartition(5)


def apart(a, b):
    return math.dist(a, b) if a is not None and b is not None and len(a) == len(b) else None


def test_sums_are_those_of_all_pairs(spark, vectors):
    rows, df = vectors
    for weight in (None, "w"):
        want = {}
        for k, g, x, _ in rows:
            if g is not None:
                some = [apart(x, y) * (w if weight else 1) for _, h, y, w in rows if h == g and apart(x, y) is not None and (w is not None or not weight)]
                want[k] = sum(some) if some else None
        got = {r["k"]: r["total"] for r in cluster.distance_sums(df, "k", "g", "x", weight).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == (v if v is None else pytest.approx(v, abs=1e-9))


def test_the_lowest_of_equal_medoids_wins(spark, vectors):
    rows, df = vectors
    got = {r["g"]: r["medoid"] for r in cluster.medoids(df, "k", "g", "x").collect()}
    for g in (0, 1, 2, 7):
        sums = {k: sum(apart(x, y) for _, h, y, _ in rows if h == g and apart(x, y) is not None) for k, h, x, _ in rows if h == g and x is not None}
        assert got[g] == min((math.floor(v * 1e9 + 0.5), k) for k, v in sums.items())[1]


def test_weights_move_the_medoid(spark, vectors):
    rows, df = vectors
    got = {r["g"]: r["medoid"] for r in cluster.medoids(df, "k", "g", "x", "w").collect()}
    for g in (0, 1, 2):
        sums = {k: sum(apart(x, y) * w for _, h, y, w in rows if h == g and apart(x, y) is not None) for k, h, x, _ in rows if h == g and x is not None}
        assert got[g] == min((math.floor(v * 1e9 + 0.5), k) for k, v in sums.items())[1]


def test_silhouettes_are_those_of_all_pairs(spark, vectors):
    rows, df = vectors
    got = {r["k"]: r["silhouette"] for r in cluster.silhouettes(df, "k", "g", "x").collect()}
    assert got.keys() == {r[0] for r in rows}
    for k, g, x, _ in rows:
        by = {}
        for j, h, y, _ in rows:
            if j != k and apart(x, y) is not None:
                by.setdefault(h, []).append(apart(x, y))
        means = {h: sum(v) / len(v) for h, v in by.items()}
        own, near = means.get(g) if g is not None else None, min((v for h, v in means.items() if h is not None and h != g), default=None) if g is not None else None
        want = (near - own) / max(near, own) if own is not None and near is not None else 0.0
        assert got[k] == pytest.approx(want, abs=1e-9), k


def test_no_join_makes_the_pairs(spark, vectors):
    """Pairs of rows stay inside the tasks' matrices."""
    plans = [f(vectors[1], "k", "g", "x")._jdf.queryExecution().optimizedPlan().toString() for f in (cluster.distance_sums, cluster.medoids, cluster.silhouettes)]
    assert all("FlatMapGroupsInArrow" in p for p in plans)


def test_near_and_infinite_vectors_keep_their_distances():
    import numpy as np

    x = np.array([[1e6, 1.0], [1e6, 1.0 + 1e-7], [1e6, 1.0], [np.inf, 0.0], [-1e6, 5.0]])
    got = kernels.distances(x, x)
    assert got[0, 2] == 0 and got[0, 1] == pytest.approx(1e-7, rel=1e-6) and got[0, 4] == pytest.approx(math.dist(x[0], x[4]))
    assert np.isinf(got[3, 0]) and np.isnan(got[3, 3])


def test_layout_is_the_classical_scaling_of_the_distances(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 5)) * [9, 5, 2, 1, 1] + 100
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(90, None)], "k long, x array<double>").repartition(4)
    got = {r["k"]: r["place"] for r in cluster.scaled_layout(df, "k", "x", 2).collect()}
    want = kernels.classical_scaling(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 2)
    assert got.pop(90) is None and np.allclose([got[k] for k in range(90)], want, atol=1e-8)


def test_layout_of_a_space_too_large_for_its_distances(spark):
    """30,000 vectors have 7 GB of distances."""
    df = spark.range(30_000).selectExpr("id AS k", "array(CAST(id AS DOUBLE), CAST(id % 7 AS DOUBLE), 3.0D) AS x")
    best = cluster.scaled_layout(df, "k", "x", 2).selectExpr("max(place[0]) AS a", "min(place[0]) AS b").first()
    assert best["a"] == pytest.approx(14999.5, abs=0.01) and best["b"] == pytest.approx(-14999.5, abs=0.01)


def test_layout_of_few_rows_or_components(spark):
    place = lambda rows, dims: [r["place"] for r in cluster.scaled_layout(spark.createDataFrame(rows, "k long, x array<double>"), "k", "x", dims).collect()]
    assert place([], 2) == [] and place([(1, [4.0])], 2) == [[0.0]]
    assert sorted(place([(1, [1.0]), (2, [5.0])], 2)) == [[-2.0, 0.0], [2.0, 0.0]]
