"""Solver queries over every key of a group, against brute force."""

from itertools import pairwise

from rateloom import catalog


def test_sample_cap_search_takes_every_size(spark, tmp_path):
    sizes = {"a": [1, 2, 4, 9, 15, 16, 18, 30, 44], "b": [3, 5, 6, 7, 30, 31, 33, 50], "c": [7]}
    rows = [(b, k) for b, s in sizes.items() for k in s * 2]
    spark.createDataFrame(rows, "p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for b, s in sizes.items():
        cuts = [[0, len(s)]] + [[0, k, len(s)] for k in range(1, len(s))]
        widths = [[s[j - 1] - s[i] for i, j in pairwise(c)] for c in cuts]
        want[b] = min(float(sum(w * w for w in x)) for x in widths if sum(w + 10 for w in x) <= 60)
    assert {r["p_brand"]: r["loss"] for r in catalog.QUERIES["sample_cap_search"](spark, str(tmp_path)).collect()} == want


def test_solvers_take_every_type_and_size(spark, tmp_path):
    from itertools import product

    sizes = {"a": [1, 2, 4, 9, 15, 16, 18, 30, 44], "b": [3, 5, 6, 7, 30, 31, 33, 50], "c": [7]}
    rows = [(b, f"t{k % 4}", k, float((k * 37) % 11 + len(b))) for b, s in sizes.items() for k in s]
    spark.createDataFrame(rows, "p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    cuts, choice = {}, {}
    for b, s in sizes.items():
        best = []
        for mask in product([0, 1], repeat=len(s) - 1):
            ends = [0, *(k + 1 for k, m in enumerate(mask) if m), len(s)]
            widths = [s[j - 1] - s[i] for i, j in pairwise(ends)]
            if sum(w + 10 for w in widths) <= 90:
                best.append(float(sum(w * w for w in widths)))
        cuts[b] = min(best)
        types = {}
        for _, t, k, loss in (r for r in rows if r[0] == b):
            types.setdefault(t, []).append((k, loss))
        budget = sum(min(k for k, _ in p) for p in types.values()) + 12
        choice[b] = min(sum(x for _, x in c) for c in product(*types.values()) if sum(k for k, _ in c) <= budget)
    assert {r["p_brand"]: r["loss"] for r in catalog.QUERIES["partition_dp_small"](spark, str(tmp_path)).collect()} == cuts
    assert {r["p_brand"]: r["loss"] for r in catalog.QUERIES["mckp_exact_small"](spark, str(tmp_path)).collect()} == choice
