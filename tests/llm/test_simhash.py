import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from rateloom.llm import simhash

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    import re

    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(up))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    """rows: (doc_id, unsigned fingerprint)."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3):
            a, b = find(f), find(fps[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in rows}


def test_fingerprints_match_the_definition():
    for text in [None, "", "  ", "One", "a B", "a b c", "É é x y z a b c a b c", "Tab\tand\x0bvt \x1c fs", "w " * 3000]:
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text), text


@pytest.mark.parametrize("leaf_size", [16, 100_000])
def test_components_of_planted_chains(spark, leaf_size):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 20])):
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                f ^= 1 << b
            fps.append(f)
    base = rng.getrandbits(64)  # a dense ball
    fps += [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)]
    rows = [(k, f) for k, f in enumerate(fps)]
    rng.shuffle(rows)
    signed = [(d, f - 2**64 if f >= 2**63 else f) for d, f in rows]
    prints = spark.createDataFrame(signed, "doc_id long, fp long")
    found = {r["fp"] % 2**64: r["component_id"] for r in simhash.components(prints, leaf_size=leaf_size).collect()}
    assert {f: found[f] for _, f in rows} == {f: c for (_, f), c in brute_components(rows).items()}


def test_query_against_brute_force(spark):
    found = simhash.op7_simhash(spark, "/root/testdata/sf0.01").collect()
    rows = [(r["doc_id"], int(r["fingerprint"], 16)) for r in found]
    assert len(rows) == 1000 and {len(r["fingerprint"]) for r in found} == {16}
    want = brute_components(rows)
    assert all(want[r["doc_id"], int(r["fingerprint"], 16)] == r["component_id"] for r in found)
    sizes = defaultdict(int)
    for r in found:
        sizes[r["component_id"]] += 1
    assert max(sizes.values()) > 1


def test_awkward_tables(spark):
    rows = [(1, None, None, None, None), (5, "", "", "", 0), (5, "", "", "", 0), (None, "a b c", "x", "y", 1), (7, "z " * 40000, "x", "y", 1)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS fp", "2 AS component_id")
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [("1", "1"), ("5", "1"), ("5", "1"), ("7", "7"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def edited(rng, words, rate):
    return [w if rng.random() > rate else "".join(rng.choices("qxz", k=6)) for w in words]


def jaccard(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_finds_copies_of_a_similarity_of_four_fifths(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 4)))
    texts, pairs = [], []
    for _ in range(300):
        own = [word() for _ in range(rng.randint(60, 300))]
        copy = edited(rng, own, rng.choice([0.0, 0.005, 0.015, 0.2]))
        pairs.append((len(texts), len(texts) + 1, jaccard(own, copy)))
        texts += [own, copy]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    rows, found = simhash.similar(docs, leaf_size=64)
    of = {r["doc_id"]: r["component_id"] for r in rows.join(found, "node").collect()}
    close = [of[a] == of[b] for a, b, j in pairs if j >= 0.8]
    assert sum(close) > 0.95 * len(close) > 100
    assert not any(of[a] == of[b] for a, b, j in pairs if j < 0.5)
    assert len(set(of.values())) >= 300
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert kept == set(of.values())


def components_of(spark, texts, leaf_size):
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    rows, found = simhash.similar(docs, leaf_size=leaf_size)
    return {r["doc_id"]: r["component_id"] for r in rows.join(found, "node").collect()}


def test_similar_finds_truncated_and_extended_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 4)))
    texts, pairs = [], []
    for k in range(300):
        own = [word() for _ in range(rng.randint(60, 300))]
        share = rng.uniform(0.02, 0.18)
        cut = own[: len(own) - int(share * len(own))]
        copy = [cut, own + own[: int(share * len(own))], own + ["".join(rng.choices("qxz", k=6)) for _ in range(int(share * len(own)))]][k % 3]
        pairs.append((len(texts), len(texts) + 1, jaccard(own, copy)))
        texts += [own, copy]
    of = components_of(spark, texts, 4096)
    close = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(close) > 250 and all(of[a] == of[b] for a, b in close)


@pytest.mark.parametrize("leaf_size", [4, 4096])
def test_similar_links_at_four_fifths_only(spark, leaf_size):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 4)))
    texts = []
    for _ in range(60):
        own = [word() for _ in range(rng.randint(100, 200))]
        texts += [own, *(edited(rng, own, rate) for rate in (0.01, 0.025, 0.03, 0.035, 0.04))]
    root = list(range(len(texts)))
    between = 0
    for at in range(0, len(texts), 6):
        for a in range(at, at + 6):
            for b in range(a + 1, at + 6):
                j = jaccard(texts[a], texts[b])
                between += 0.65 <= j < 0.8
                if j >= 0.8:
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
    assert between > 100 and len(set(root)) < len(texts)
    assert components_of(spark, texts, leaf_size) == dict(enumerate(root))


def test_one_of_each_of_awkward_tables(spark):
    rows = [(1, None, None, None, None), (5, "", "", "", 0), (5, "", "", "", 0), (None, "a b c", "x", "y", 1), (None, "d e f", "x", "y", 1), (7, "z " * 4000, "x", "y", 1), (7, "z " * 4000, "x", "y", 1), (7, "other words stand here", "x", "y", 1), (8, "z " * 4000, "x", "y", 1)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS node", "2 AS component_id")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect()) == [("1", ""), ("7", "other"), ("7", "z z z"), ("None", "a b c"), ("None", "d e f")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_a_large_leaf_is_split_by_a_tree_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LOCAL_LEAF", 32)
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in base for _ in range(8)]
    node = np.array(sorted(set(fps)), np.uint64).view(np.int64)
    home = np.array([rng.random() < 0.7 for _ in node])
    none = np.zeros((len(node), 0), np.int64)

    def groups(edges):
        root = {int(n): int(n) for n in node}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*(e.tolist() for e in edges)):
            root[find(a)] = find(b)
        return {frozenset(k for k in root if find(k) == r) for r in map(find, root)}

    whole = groups(simhash.leaf_stars(node, node, np.ones(len(node), bool), none, 3, 0))
    assert groups(simhash.local_stars(node, node, np.ones(len(node), bool), none, 3, 0)) == whole
    # with visitors: every link of a home is there, and nothing that is not linked
    links = {(int(a), int(b)) for a, h in zip(node, home) if h for b in node[simhash.distance(node, a) <= 3]}
    found = groups(simhash.local_stars(node, node, home, none, 3, 0))
    assert all(any({a, b} <= g for g in found) for a, b in links)
    assert all(any(g <= w for w in whole) for g in found)


def test_one_of_each_drops_what_the_fingerprints_link(spark):
    """A short passage many times over, with four words more: shingle sets are not alike, fingerprints are."""
    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa omega".split()
    text = own * 40
    texts = [text, [*text, "lambda", "mu", "nu", "xi"], "quite another text of its own words stands here".split()]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    prints = [simhash.fingerprint(" ".join(t)) for t in texts]
    assert bin((prints[0] ^ prints[1]) & (2**64 - 1)).count("1") <= simhash.BITS and jaccard(texts[0], texts[1]) < 0.8
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 2]
