"""License scans: a positional index of the rarest license words, over documents as DataFrame expressions only.

Template. Each license notice is a sequence of words with a label and key phrases that must stand in it. Document
frequencies of the templates' words over all documents give their IDF. The index has, for each rare word (one of an IDF of
`MIN_IDF` or more, that is, in at most a fifth of the documents), its postings: every (template, position) at which it
stands. A template without a rare word is posted by its rarest.

Search. A file's words of highest IDF, those that are in the index, are looked up, each place p of one posting the start
p - position for every posting of the word. Starts are sorted and counted: a template stands where at least `SHARE` of
its postings agree on one start, so words in between may differ. It counts if its key phrases stand at their places
behind that start.

The base rules count four phrases of consecutive words. Their labels stay whatever the templates say.

Score: the largest share of postings that a verified template has; at least 0.5 where a base phrase stands; else 0.

Texts are lower-cased in A-Z only (the one other letter that lower() turns into ASCII, the Kelvin sign, is taken out of
its way first). A document is one row throughout: there is no join, no shuffle of texts and no Python; only the
templates' word counts are gathered, a row for each word of the templates.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.session import table

MIN_IDF = math.log(5)
SHARE = 0.75
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases with their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Wordings of well-known license notices, their labels, and the phrases that must be present.
TEMPLATES = [
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-notice", "licensed under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-or-later", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]


def spaced(text: Column) -> Column:
    """Each word between two blanks of its own: ' one  two '. Empty without words."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "K", "ķ"))
    words = F.trim(F.regexp_replace(plain, NON_WORD, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def words_of(spaced_text: Column) -> Column:
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(spaced_text), "  "))


def needle(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(text: Column, phrase: str) -> Column:
    """Count, first and last place of a phrase, in words from 0. Places never overlap, for no phrase begins with its end."""
    n = needle(phrase)
    count = (F.length(text) - F.length(F.replace(text, F.lit(n), F.lit("")))) / len(n)
    first = blanks(F.substring_index(text, n, 1)) / 2
    last = blanks(text) / 2 - len(phrase.split()) - blanks(F.substring_index(text, n, -1)) / 2
    found = F.struct(*(F.round(c).cast("long").alias(a) for c, a in ((count, "n"), (first, "first"), (last, "last"))))
    return F.when(F.contains(text, F.lit(n)), found)


def vocabulary() -> list[str]:
    return sorted({w for _, wording, _ in TEMPLATES for w in wording.split()})


def literal_words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def document_frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each word of the templates stands, and the number of documents. texts: spaced."""
    listed = F.explode_outer(F.array_intersect(words_of(F.col("spaced")), literal_words(vocabulary())))
    rows = texts.select(listed.alias("word")).groupBy("word").count().collect()  # a row a word of the templates
    total = texts.count()
    return {r["word"]: r["count"] for r in rows if r["word"]}, total


def postings(frequency: dict[str, int], total: int) -> list[list[tuple[str, int]]]:
    """For each template its rare words with their positions; the rarest (ties: the first) if none is."""
    out = []
    for _, wording, _ in TEMPLATES:
        words = wording.split()
        rare = [k for k, w in enumerate(words) if frequency.get(w, 0) * round(math.exp(MIN_IDF)) <= total]
        rare = rare or [min(range(len(words)), key=lambda k: (frequency.get(words[k], 0), k))]
        out.append([(words[k], k) for k in rare])
    return out


def candidates(words: Column, index: list[list[tuple[str, int]]]) -> Column:
    """Array of (template, start, share of anchors) for starts on which enough postings agree."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for t, listed in enumerate(index):
        for w, k in listed:
            by_word.setdefault(w, []).append((t, k))
    lookup = F.create_map(*(x for w, at in sorted(by_word.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in at)))))
    rare = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(sorted(by_word)))
    posted = F.flatten(F.transform(rare, lambda s: F.transform(F.element_at(lookup, s["w"]), lambda a: F.struct(a["t"].alias("t"), (s["i"] - a["k"]).alias("s")))))
    need = F.array(*(F.lit(max(1, math.ceil(SHARE * len(listed)))) for listed in index))
    full = F.array(*(F.lit(float(len(listed))) for listed in index))
    empty = F.array().cast("array<struct<t:int,s:int,share:double>>")
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("s"), F.lit(0).alias("n"), empty.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        # sorted starts come in runs; a run is taken when it reaches the number needed, and its share follows its length
        n = F.when((acc["t"] == p["t"]) & (acc["s"] == p["s"]), acc["n"] + 1).otherwise(F.lit(1))
        hit = F.array(F.struct(p["t"].alias("t"), p["s"].alias("s"), (n / F.get(full, p["t"])).alias("share")))
        out = F.when(n >= F.get(need, p["t"]), F.concat(acc["out"], hit)).otherwise(acc["out"])
        return F.struct(p["t"].alias("t"), p["s"].alias("s"), n.alias("n"), out.alias("out"))

    return F.aggregate(F.array_sort(posted), start, step, lambda acc: acc["out"])


def verified(words: Column, candidate: Column) -> Column:
    """Whether all key phrases of the candidate's template stand at their places."""
    checks = F.lit(False)
    for t, (_, wording, phrases) in enumerate(TEMPLATES):
        all_here = F.lit(True)
        for phrase in phrases:
            want, inside = phrase.split(), wording.split()
            offset = next(k for k in range(len(inside)) if inside[k : k + len(want)] == want)
            begin = candidate["s"] + offset
            all_here = all_here & (begin >= 0) & (F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.lit(len(want))) == literal_words(want))
        checks = F.when(candidate["t"] == t, all_here).otherwise(checks)
    return checks


def scan(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    base = documents.select(F.col(doc_id).alias("doc_id"), spaced(F.col(text)).alias("spaced"))
    frequency, total = document_frequencies(base.select("spaced"))
    index = postings(frequency, total)
    rows = base.withColumn("n_words", (blanks(F.col("spaced")) / 2).cast("long"))
    for _, label in BASE:
        phrase = next(p for p, x in BASE if x == label)
        rows = rows.withColumn(f"at_{label}", places(F.col("spaced"), phrase))
    every = sorted({w for listed in index for w, _ in listed})
    rows = rows.withColumn("words", words_of(F.col("spaced")))
    found = F.filter(candidates(F.col("words"), index), lambda c: verified(F.col("words"), c))
    rows = rows.withColumn("matches", F.when(F.exists("words", lambda w: w.isin(every)), found).otherwise(F.array().cast("array<struct<t:int,s:int,share:double>>")))
    at = [F.col(f"`at_{label}`") for _, label in BASE]
    base_labels = F.array_compact(F.array(*(F.when(c.isNotNull(), F.lit(label)) for c, (_, label) in zip(at, BASE, strict=True))))
    names = literal_words([label for label, _, _ in TEMPLATES])
    own = F.transform(F.col("matches"), lambda m: F.get(names, m["t"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), F.when(F.size(base_labels) > 0, 0.5).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", reduce(lambda a, b: a + b, (F.coalesce(c["n"], F.lit(0)) for c in at)).cast("long").alias("n_base"),
        F.least(*(c["first"] for c in at)).alias("first_word"), F.greatest(*(c["last"] for c in at)).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, own)).alias("labels"), best.alias("score"), "matches",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("matches")


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(map(str, rows))}) AS x({names})"


def sql() -> str:
    """The same scan in DuckDB: postings by document frequency, starts by counting, key phrases by joining their words."""
    words, phrases, labels = [], [], []
    for t, (label, wording, keys) in enumerate(TEMPLATES):
        inside = wording.split()
        labels.append((t, label))
        words += [(t, k, w) for k, w in enumerate(inside)]
        for p, phrase in enumerate(keys):
            want = phrase.split()
            at = next(k for k in range(len(inside)) if inside[k : k + len(want)] == want)
            phrases += [(t, p, at + k, w) for k, w in enumerate(want)]
    base = [(label, k, w, len(phrase.split())) for phrase, label in BASE for k, w in enumerate(phrase.split())]
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
spot AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM w),
tw AS (SELECT * FROM {_values(words, 't, k, word')}), ph AS (SELECT * FROM {_values(phrases, 't, p, k, word')}),
lab AS (SELECT * FROM {_values(labels, 't, label')}), bp AS (SELECT * FROM {_values(base, 'label, k, word, size')}),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM spot WHERE word IN (SELECT word FROM tw) GROUP BY word),
ranked AS (SELECT tw.*, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), k) AS rn FROM tw LEFT JOIN df USING (word)),
anchor AS (SELECT t, k, word, count(*) OVER (PARTITION BY t) AS full_size FROM ranked WHERE rn = 1 OR df * {round(math.exp(MIN_IDF))} <= (SELECT count(*) FROM documents)),
starts AS (SELECT doc_id, t, i - k AS s, count(*) / CAST(max(full_size) AS DOUBLE) AS share FROM spot JOIN anchor USING (word) GROUP BY ALL HAVING count(*) >= ceil({SHARE} * max(full_size))),
seen AS (SELECT s.doc_id, s.t, s.s, count(*) AS hit FROM starts s JOIN ph ON ph.t = s.t JOIN spot ON spot.doc_id = s.doc_id AND spot.i = s.s + ph.k AND spot.word = ph.word GROUP BY ALL),
good AS (SELECT s.* FROM starts s JOIN seen USING (doc_id, t, s) WHERE hit = (SELECT count(*) FROM ph WHERE ph.t = s.t)),
based AS (SELECT doc_id, label, i - k AS i FROM spot JOIN bp USING (word) GROUP BY doc_id, label, i - k, size HAVING count(*) = size),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM based GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM based) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM based UNION SELECT doc_id, label FROM good JOIN lab USING (t)) GROUP BY doc_id),
sc AS (SELECT doc_id, max(share) AS share FROM good GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


OP6_SQL = sql()
