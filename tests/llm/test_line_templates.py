import math
import random
import re
from collections import defaultdict

from rateloom.llm import line_templates as lt

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def mask(line):
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split(" "))


def usable(line):
    return line.count(" ") + 1 >= lt.MIN_TOKENS and line.strip(" ") != ""


def brute(texts, min_docs=lt.MIN_DOCS):
    """Dropped line numbers of each different text."""
    rows = [(t, k, mask(x)) for t in set(texts) - {None} for k, x in enumerate(t.split("\n"))]
    rows = [r for r in rows if usable(r[2])]
    whole, leaf = defaultdict(set), defaultdict(set)
    leaf_of = lambda x: (x.count(" ") + 1, tuple(x.split(" ")[: lt.DEPTH]))
    for t, _, x in rows:
        whole[x].add(t)
        leaf[leaf_of(x)].add(t)
    rest = [r for r in rows if len(whole[r[2]]) < min_docs and len(leaf[leaf_of(r[2])]) >= min_docs]
    token = defaultdict(set)
    for t, _, x in rest:
        f = leaf_of(x)
        for i, w in enumerate(x.split(" ")):
            token[f, i, w].add(t)
    shapes, found = defaultdict(set), defaultdict(set)
    for t, k, x in rest:
        f, w = leaf_of(x), x.split(" ")
        level = [-1 if y == "<*>" else int(math.log2(len(token[f, i, y]) / min_docs) // 1) for i, y in enumerate(w)]
        for least in {v for v in level if v >= 0}:
            s = tuple(y if v >= least else "<*>" for y, v in zip(w, level))
            if sum(y != "<*>" for y in s) >= len(w) * lt.CONSTANT:
                shapes[t, k].add((f, s))
                found[f, s].add(t)
    out = defaultdict(set)
    for t, k, x in rows:
        if len(whole[x]) >= min_docs or any(len(found[s]) >= min_docs for s in shapes[t, k]):
            out[t].add(k)
    return out


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    drop = brute([r["text"] for r in rows])
    want = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = t if not drop.get(t) else "\n".join(x for k, x in enumerate(lines) if k not in drop[t])
        want.append((i, sum(x.strip(" ") != "" for x in lines), len(drop.get(t, ())), kept))
    got = [tuple(r) for r in lt.cleaned(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_planted_templates_go(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    texts = []
    for k in range(60):
        own = "\n".join(" ".join(word() for _ in range(8)) for _ in range(3))
        texts.append(f"{own}\nPosted by user {word()} on this site today\nPage {k} of 99 in total\n\n{own[:20]} é")
    texts += [texts[0]] * 30 + [None, "", " \n ", "a b\nc d", "same four words here " * 9000, "x 1 2 3\n" * 9]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], ROWS).selectExpr("*", "1 AS doc", "2 AS at", "'x' AS line")
    got = {r[0]: r for r in check(docs)}
    assert all(got[k][2] == 2 and "Posted by" not in got[k][3] and "Page" not in got[k][3] for k in range(60))
    assert lt.cleaned(docs.limit(0)).count() == 0


def test_whole_table(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r[2] > 0 for r in got) > 10


def test_templates_of_a_busy_leaf_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [f"We at home keep the same old lines here {'' if k else 'x'}\n{word()}" for k in range(700)]
    for k in range(240):  # six templates in the leaf of the exact line above, each with two fields
        a = "abcdef"[k % 6]
        texts.append(f"We at home {a}one {a}two {a}three {a}four {word()} {a}five {word()}\n{word()}")
    texts += [f"We at home " + " ".join(word() for _ in range(7)) for _ in range(50)]  # prose in the same leaf
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    got = {r[0]: r[2] for r in check(docs)}
    assert all(got[k] == 1 for k in range(700, 940)) and not any(got[k] for k in range(940, 990))
    assert sum(got[k] for k in range(700)) >= 699


def test_a_value_that_recurs_does_not_hide_its_template(spark):
    names = ["ann"] * 7 + ["bob"] * 5 + [f"{c}x" for c in "abcdefghijklmnopqrst"]
    texts = [f"Posted by user {w} on this {'good' if w == 'ann' else 'fine' if k % 3 else 'old'} site\n{'ab' * k}" for k, w in enumerate(names)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    dropped = {r[0]: r[2] for r in check(docs)}
    assert all(dropped[k] == 1 for k in range(7, 32))


def test_a_very_long_line_costs_in_proportion(spark):
    words = " ".join(["ab", "cd", "ef", "gh"] * 5000)
    texts = [f"{words} end{'abcdefghijkl'[k]} over" for k in range(12)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    assert {r[2] for r in check(docs)} == {1}


def test_salted_levels_equal_broadcast_ones(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(map(tuple, lt.cleaned(docs).collect()))
    monkeypatch.setattr(lt, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, lt.cleaned(docs).collect())) == want


def test_templates_are_named(spark):
    texts = [f"Posted by user {'abcdefghijklmnop'[k]}x on this site today" for k in range(12)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], ROWS)
    _, named = lt.templates(docs)
    assert [(r["template"], r["docs"]) for r in named.collect()] == [("Posted by user <*> on this site today", 12)]


def test_large_level_tables_stay_off_the_driver(spark):
    tokens = spark.range(40).selectExpr("id AS doc", "0 AS at", "id * 5000 AS spot")
    levels = spark.range(200_000).selectExpr("id AS spot", "1 AS level")
    met = lt.with_level(tokens, levels)
    assert "broadcast" not in met._jdf.queryExecution().logical().toString().lower()
    assert met.count() == 40


def test_large_tables_are_not_broadcast_by_their_estimated_size(spark, tmp_path):
    spark.range(lt.BROADCAST_ROWS + 1).selectExpr("id * 7 AS spot", "1 AS level").write.parquet(f"{tmp_path}/levels")
    levels = spark.read.parquet(f"{tmp_path}/levels")
    tokens = spark.range(40).selectExpr("id AS doc", "0 AS at", "id * 7 AS spot").repartition(2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for met in (lt.with_level(tokens, levels), tokens.join(lt.small(levels.select("spot")), "spot", "left_semi")):
            rows = len(met.collect())
            assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and rows == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
