import itertools
import random
from collections import defaultdict

import pytest

from rateloom.llm import mixing, sharding

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_capacity(sizes, shards):
    best = None
    for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cut, len(sizes)]
        worst = max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges))
        best = worst if best is None else min(best, worst)
    return best


def test_smallest_capacity_is_the_best_of_all_cuts():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 5, 40]) for _ in range(rng.randint(0, 9))]
        assert sharding.smallest_capacity(sizes, 3) == brute_capacity(sizes, 3)


def test_refined_cuts_equal_the_search_over_all_groups(spark):
    rng = random.Random(2)
    rows = [(f"{rng.getrandbits(256):064x}", rng.choice([1, 3, 50, 400])) for _ in range(3000)]
    groups = spark.createDataFrame(rows, "digest string, size long")
    _, capacity = sharding.contiguous_cuts(groups, 8)
    assert capacity == sharding.smallest_capacity([s for _, s in sorted(rows)], 8)


def check_shards(rows, shards=8):
    by = defaultdict(list)
    group = {}
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert group.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    return by


def test_shards_of_awkward_tables(spark):
    rows = [(1, "a", None, None, 1), (1, "a", None, None, 1), (None, None, None, None, None), (None, None, None, None, None), (2, "", "x", "y", 0), (3, "long " * 30000, "x", "y", 0)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS shard", "'x' AS digest", "2 AS slot")
    found = sharding.sharded(docs).collect()
    assert len(found) == 6
    check_shards(found)
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_one_large_group_leaves_the_rest_even(spark):
    rows = [(k, "hot " * 50 if k % 3 == 0 else f"text {k} " * 20, "en", "s", 0) for k in range(3000)]
    found = sharding.sharded(spark.createDataFrame(rows, ROWS)).collect()
    check_shards(found)
    load = defaultdict(int)
    for r in found:
        load[r["shard"]] += r["size"]
    assert len(load) == 8
    rest = sorted(load.values())[:-1]
    assert rest[-1] - rest[0] <= 0.02 * sum(rest) / 7 + 400


def naive_seats(votes, seats, caps):
    given = [0] * len(votes)
    for _ in range(seats):
        free = [k for k in range(len(votes)) if votes[k] > 0 and given[k] < caps[k]]
        if not free:
            break
        given[max(free, key=lambda k: (votes[k] / (2 * given[k] + 1), -k))] += 1
    return given


def test_seats_equal_the_plain_highest_quotients():
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.choice([0.0, 1.0, 2.0, rng.random() * 50]) for _ in range(rng.randint(1, 7))]
        caps = [rng.randint(0, 30) for _ in votes]
        seats = rng.randint(0, 80)
        assert mixing.sainte_lague(votes, seats, caps) == naive_seats(votes, seats, caps)


def test_waterfill_never_exceeds_and_spends_all():
    sizes = [100, 10, 1000, 0]
    targets = mixing.waterfill(sizes, [5, 2, 1, 5], 1665.0)
    assert targets[3] == 0 and all(t <= 2 * s for t, s in zip(targets, sizes))
    assert sum(targets) == pytest.approx(1665.0)


def brute_taken(rows, seed=mixing.SEED):
    """Word by word: the stream of each source, its blocks, and the copies of each."""
    import re

    streams = defaultdict(list)
    for h, doc, source, text in sorted(rows, key=lambda r: (r[0], (r[1] is not None, r[1] or 0))):
        streams[source] += [doc] * len(re.findall(mixing.WORD, text or ""))
    taken = defaultdict(int)
    totals = {s: len(w) for s, w in streams.items()}
    for _, _, source, _ in rows:
        totals.setdefault(source, 0)
    for p in mixing.plan(list(totals.items())):
        for place, doc in enumerate(streams[p["source"]]):
            b = min(place // p["block"], p["n_blocks"] - 1)
            j, k = b % mixing.MIX_SHARDS, b // mixing.MIX_SHARDS
            n, q = p["here"][j], p["seats"][j]
            taken[doc] += q // n + ((p["step"][j] * k + p["shift"][j]) % n < q % n)
    return taken


def test_taken_equals_the_walk_over_single_words(spark):
    from pyspark.sql import functions as F

    from rateloom.session import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id")).alias("h"), "doc_id", "source", "text")
    # ranges are ordered by the unsigned hash, ties inside a range by the signed one: the same order within a range
    walk = [(((r[0] % 2**64) >> 52, r[0]), r[1], r[2], r[3]) for r in rows.collect()]
    want = brute_taken(walk)
    found = mixing.mixed(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in found} == {r[1]: want[r[1]] for r in walk}
    by = defaultdict(lambda: [0, 0])
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    for got, target in by.values():
        assert abs(got - target) <= 0.01 * target + 2


def test_mix_of_awkward_tables(spark):
    rows = [(1, "a b c", None, None, 1), (1, "a b c", None, None, 1), (None, None, None, "s", None), (2, "", "x", "s", 0), (3, "w " * 5000, "x", "t", 0)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS size", "2 AS target")
    found = mixing.mixed(docs).collect()
    assert len(found) == 5 and sum(r["size"] for r in found) == 5006
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_emitted_texts_hold_the_taken_words():
    text = "a  b\nc d e"
    spans = [{"a": 0, "b": 2, "n": 1}, {"a": 2, "b": 3, "n": 0}, {"a": 3, "b": 5, "n": 2}]
    assert mixing.cut_words(text, spans) == ["a  b\nd e", "d e"]
    assert mixing.cut_words(text, [{"a": 0, "b": 5, "n": 2}]) == [text, text]


def test_a_tiny_source_has_short_blocks_of_its_own():
    big = [("big", 10**13), ("mid", 10**12)]
    alone, beside = mixing.plan(big), mixing.plan([*big, ("tiny", 300)])
    assert [p["block"] for p in beside[:2]] == [p["block"] for p in alone] and beside[2]["block"] == 1
    for p in beside:
        taken = sum(p["seats"]) * p["block"]
        assert abs(taken - p["target"]) <= p["target"] / 256 + 2
        assert all(s <= mixing.MAX_REPEAT * h for s, h in zip(p["seats"], p["here"]))
        assert p["n_blocks"] <= 2**mixing.MOST_BLOCKS


def test_picked_blocks_lie_apart():
    p = mixing.plan([("a", 4_000_000), ("b", 1_000_000)])[0]
    n, q = p["here"][0], p["seats"][0] % p["here"][0]
    picked = [k for k in range(n) if (p["step"][0] * k + p["shift"][0]) % n < q]
    assert len(picked) == q
    for parts in (4, 16):
        for j in range(parts):
            inside = sum(j * n // parts <= k < (j + 1) * n // parts for k in picked)
            assert abs(inside - q / parts) <= 3
