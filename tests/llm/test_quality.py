import random
import re
from collections import Counter, defaultdict

import numpy as np

from rateloom.llm import quality

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def counts(text):
    n_words, word_chars, _, n_symbols, _, n_dup, n_rep = quality.text_counts(text)
    return n_words, word_chars, n_symbols, n_dup, n_rep


def test_counts_against_brute_force():
    rng = random.Random(0)
    texts = [None, "", " \n ", "a", "é\x1cb  c\n\n#*$\n#*$", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n \nx"]
    texts += [" ".join(rng.choices("ab c d\n e f ## é".split(" "), k=rng.randint(0, 60))) for _ in range(400)]
    texts.append(" ".join(f"w{k}" for k in range(70000)) + " w5 w6 w7 w8 w9")  # too many words for one packed key
    for t in texts[:-1]:
        assert counts(t) == brute(t), t
    assert counts(texts[-1])[4] == 10


def test_concentration_finds_a_small_determinant_and_the_outliers(spark):
    rng = np.random.default_rng(3)
    clean = rng.normal(size=(900, 5)) * [0.3, 0.2, 0.4, 0.5, 1.0]
    bad = rng.normal(size=(100, 5)) * 0.1 + [4, 4, 4, 4, 9]
    rows = [("k", *map(float, v)) for v in np.vstack([clean, bad])]
    vectors = spark.createDataFrame(rows, ["key", *quality.X])
    fit, scale = quality.outlier_distances(vectors)
    r = fit.join(scale, "key").first()
    x = np.vstack([clean, bad]) - np.array(r["mean"])
    d = np.einsum("ni,ij,nj->n", x, np.array(r["inverse"]).reshape(5, 5), x) * r["scale"]
    assert d[900:].min() > 5 * np.quantile(d[:900], 0.99)
    floor = np.diag(np.square(quality.FLOORS))
    for _ in range(200):
        some = np.vstack([clean, bad])[rng.choice(1000, 750, replace=False)]
        assert r["logdet"] <= np.linalg.slogdet(np.cov(some.T, bias=True) + floor)[1]


def test_query_keeps_good_texts(spark):
    sf = "/root/testdata/sf0.1"
    found = quality.op1_quality_outliers(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    shares = found.where("not base_failed").selectExpr("quality", "cast(kept as int) k").groupBy("quality").avg("k").collect()
    rate = {r[0]: r[1] for r in shares}
    assert rate[1] > 0.995 and rate[0] < 0.2


def test_awkward_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "w " * 30000, "x", "y", 1), (4, "ten words are here to see what it does now ok", "x", "y", 1), (4, "ten words are here to see what it does now ok", "x", "y", 1), (None, "a b", "x", None, 1)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "'k' AS key", "1 AS n_words", "true AS kept")
    found = {(r["doc_id"], r["n_words"], r["kept"]) for r in quality.quality(docs).collect()}
    assert found == {(1, 0, False), (2, 0, False), (3, 30000, False), (4, 11, True), (None, 2, False)}
    assert quality.quality(docs, min_group=1).count() == 6
    assert quality.quality(docs.limit(0)).count() == 0


def test_cutoff_is_the_quantile_of_a_chi_square():
    rng = np.random.default_rng(1)
    draws = (rng.normal(size=(400_000, 5)) ** 2).sum(axis=1)
    for tail in (0.5, 0.25, 0.01, 0.001):
        assert abs((draws > quality.chi_square(tail)).mean() - tail) < 3 * (tail / 400_000) ** 0.5


def plain_mcd(x, alpha=quality.ALPHA):
    """Concentration on single rows (no histograms) from the same starts, and the judgement by the same scale."""
    floors = np.array(quality.FLOORS)
    n = len(x)
    h = int(np.ceil(n * alpha))
    rank = lambda k, share: np.sort(x[:, k])[int(np.ceil(n * share)) - 1]
    middle = np.array([rank(k, 0.5) for k in range(5)])
    spread = np.maximum([(rank(k, 0.75) - rank(k, 0.25)) / 1.349 for k in range(5)], floors)
    z = ((x - middle) / spread) ** 2
    best = None
    for d in (z.sum(axis=1), z.max(axis=1), z[:, :4].sum(axis=1)):
        for _ in range(50):
            some = x[d <= np.sort(d)[h - 1]]
            cov = np.cov(some.T, bias=True) + np.diag(floors**2)
            new = np.einsum("ni,ij,nj->n", x - some.mean(axis=0), np.linalg.inv(cov), x - some.mean(axis=0))
            if np.allclose(new, d):
                break
            d = new
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], d
    d = best[1]
    return d * min(quality.chi_square(1 - s) / np.sort(d)[int(np.ceil(n * s)) - 1] for s in (0.5, alpha))


def test_query_against_a_plain_estimate(spark):
    found = quality.op1_quality_outliers(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    rows = defaultdict(list)
    for i, r in docs.iterrows():
        n_words, word_chars, n_chars, n_symbols, n_lines, n_dup, n_rep = quality.text_counts(r.text)
        if n_words >= 10 and 100 * n_rep <= 20 * n_words:
            x = [np.log(word_chars / n_words), (n_symbols / n_chars) ** 0.5, (n_dup / n_lines) ** 0.5, (n_rep / n_words) ** 0.5, np.log(n_words)]
            rows[r.lang, r.source].append((i, x))
    groups = defaultdict(list)
    for (lang, source), some in rows.items():
        groups[(lang, source) if len(some) >= quality.MIN_GROUP else lang] += some
    rest = [k for k, some in groups.items() if len(some) < quality.MIN_GROUP]
    groups["rest"] = [r for k in rest for r in groups.pop(k)]
    judged = same = 0
    for some in groups.values():
        if len(some) >= quality.MIN_GROUP:
            far = plain_mcd(np.array([x for _, x in some])) > quality.CUTOFF
            judged += len(some)
            same += sum(bool(found.kept[i]) != bool(f) for (i, _), f in zip(some, far))
    assert judged > 500 and same > 0.99 * judged
    assert not found.kept[found.base_failed].any()
