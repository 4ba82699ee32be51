import math
import re
from collections import Counter

from rateloom.llm import licenses as lic

ROWS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def stands(w, phrase, at):
    p = phrase.split()
    return at >= 0 and w[at : at + len(p)] == p


def brute(text, index):
    w = words(text)
    hits = [(i, label) for phrase, label in lic.BASE for i in range(len(w)) if stands(w, phrase, i)]
    base, own, score = {x for _, x in hits}, set(), 0.5 if hits else 0.0
    for (label, wording, phrases), listed in zip(lic.TEMPLATES, index):
        starts = Counter(i - k for i, x in enumerate(w) for a, k in listed if a == x)
        for s, n in starts.items():
            inside = wording.split()
            at = [next(k for k in range(len(inside)) if inside[k : k + len(p.split())] == p.split()) for p in phrases]
            if n >= math.ceil(lic.SHARE * len(listed)) and all(stands(w, p, s + a) for p, a in zip(phrases, at)):
                own.add(label)
                score = max(score, n / len(listed))
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


def check(docs):
    rows = docs.collect()
    df = Counter(x for r in rows for x in set(words(r["text"])))
    index = lic.postings(df, len(rows))
    found = lic.scan(docs).drop("matches").collect()
    got = sorted((tuple(r) for r in found), key=str)
    want = sorted(((r["doc_id"], *brute(r["text"], index)) for r in rows), key=str)
    assert got == want
    return got


def test_awkward_texts(spark):
    texts = [
        None, "", " .. ", "MIT License", "mit-license MIT LICENSE", "the MIT licensee", "cc by cc by CC-BY 4.0", "Apache License, Version 2.0 Licensed under the Apache License, Version 2.0!",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu general public licence version 3", "Licensed under CC BY-NC 4.0.",
        'Permission is hereby granted, free of charge, to ANY person obtaining a copy of this Software and associated documentation files (the "software"), to deal in the software with no restriction',
        "license " * 5000 + "released under the mit license", "É Ünï Kgnu general public license", "x" * 50000, "Released   under\nthe\tMIT License.",
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(3, "MIT License", None, None, None), (None, "mit license", "", "", 1)], ROWS)
    got = check(docs.selectExpr("*", "'x' AS words", "1 AS n_words", "2 AS score", "'y' AS spaced"))
    by = {r[0]: r for r in got}
    assert by[10][6] == "cc-by,cc-by-nc-4.0" and by[8][6] == "gpl,gpl-3.0" and "mit-text" in by[11][6]
    assert lic.scan(docs.limit(0)).count() == 0


def test_whole_table(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {"apache,apache-2.0", "gpl,gpl-3.0", "mit,mit-notice", "cc-by,cc-by-nc-4.0"} <= {r[6] for r in got}
