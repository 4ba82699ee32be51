import hashlib
import re

import duckdb
import pytest

from rateloom.llm import decontam

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, window=10):
    w, hit, who = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(window, len(iw))
        for k in range(len(iw) - size + 1 if iw else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == iw[k : k + size]:
                    hit |= set(range(i, i + size))
                    who |= set() if item is None else {str(item)}
    return len(w), sorted(hit), sorted(who)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (10, "short item"), (2, ""), (3, None), (None, "x y"), (4, "a a a a a a a a a a a a"), (1, "again")]
DOCS = [
    (1, "zero one TWO three, four five six seven eight nine ten eleven twelve"), (2, "a " * 40), (3, "a " * 9), (4, None), (5, ""),
    (6, "Short   ITEM. x, y; short"), (6, "Short   ITEM. x, y; short"), (None, "again é again"), (7, ("pad " * 5000) + "short item"),
    (8, "one two three four five six seven eight nine"),
]


@pytest.mark.parametrize("max_chunk_words", [2_000_000, 30])
def test_against_brute_force(spark, max_chunk_words):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in DOCS], ROWS).selectExpr("*", "1 AS hits", "2 AS items")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 AS window")
    found = decontam.contamination(docs, bench, max_chunk_words=max_chunk_words).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r["doc_id"], r["n_words"], tuple(r["hits"]), tuple(r["items"])) for r in found), key=key)
    want = sorted(((i, n, tuple(h), tuple(w)) for i, t in DOCS for n, h, w in [brute(t, ITEMS)]), key=key)
    assert got == want
    left = decontam.uncontaminated(docs, bench, max_chunk_words=max_chunk_words)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(g[0]) for g in got if not g[2])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in DOCS], ROWS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r["hits"]) for r in decontam.contamination(docs, none).collect()} == {0}
    assert decontam.contamination(docs.limit(0), none).count() == 0


def test_spans_map_to_the_original_text():
    text = "Zero ONE, two; three"
    assert [text[a:b] for a, b in decontam.hit_spans(text, [1, 2])] == ["ONE, two"]


def test_query_equals_sql(spark):
    found = decontam.op4_decontamination(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id").values.tolist()
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = duckdb.sql(decontam.OP4_SQL + " ORDER BY doc_id").fetchall()
    assert found == [list(r) for r in want]
    assert found[0][4] and hashlib.sha256(b"").hexdigest() in {r[4] for r in found}
