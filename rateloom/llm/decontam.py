"""Benchmark decontamination with Aho-Corasick automata over the windows of the benchmark's words.

The benchmark's texts are normalised to words; each window of `window` consecutive words of an item (a shorter item
is one window) is a pattern over word numbers. One automaton scans a document's words once and gives every window
that ends at a word; word numbers map back to character offsets in the original text.

An automaton is held by each Python worker, so its size is bounded: items are packed into chunks of at most
`max_chunk_words` words by their sizes, and each chunk is one automaton and one scan. A usual benchmark is one chunk;
a benchmark of any size stays exact, at the cost of a scan for each chunk.

Defined results: a null or empty text has no words, no hits and no items; an empty benchmark hits nothing; items
without words have no windows; repeated item ids count once; an item
without an id makes hits but is not listed; repeated document rows each give a row; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateloom.llm.arrow import alnum_words, map_columns, struct
from rateloom.session import materialize, table

WINDOW = 10
MAX_CHUNK_WORDS = 2_000_000
FOUND = "n_words long, hits array<int>, items array<string>"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def item_windows(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    if len(words) <= window:
        return {tuple(words)}
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


class Scanner:
    """An automaton over word numbers; 0 stands for every word that the benchmark lacks."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for words in item_windows(alnum_words(text), window):
                key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
                owners.setdefault(key, set()).update([] if item is None else [item])
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, who in owners.items():
                self.automaton.add_word(key, (len(key), frozenset(who)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of the words inside any window, and the items whose windows occur."""
        number = self.vocabulary.get
        ids = tuple([number(w, 0) for w in words])
        found: set[str] = set()
        if self.automaton is None or not any(ids):
            return np.empty(0, np.int32), found
        edge = np.zeros(len(ids) + 1, np.int32)
        for end, (size, who) in self.automaton.iter(ids):
            edge[end - size + 1] += 1
            edge[end + 1] -= 1
            found |= who
        return np.flatnonzero(np.cumsum(edge[:-1])).astype(np.int32), found


def chunks(benchmark: DataFrame, item: str, text: str, max_chunk_words: int) -> list[DataFrame]:
    """The benchmark cut into parts of bounded size, by hash of the item."""
    total = benchmark.agg(F.sum(F.length(text)).alias("n"), F.count("*").alias("k")).first()
    # a word needs two characters with its blank, and a row some room besides
    parts = max(1, -(-((total["n"] or 0) // 2 + total["k"]) // max_chunk_words))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    if parts == 1:
        return [rows]
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    return [rows.where(part == k) for k in range(parts)]


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_chunk_words: int = MAX_CHUNK_WORDS,
) -> DataFrame:
    """A row per document: doc_id, text, n_words, hits (numbers of the hit words) and items (ids with occurring windows)."""
    state = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = T.StructType([state.schema["doc_id"], state.schema["text"], *struct(FOUND).fields])
    for k, rows in enumerate(chunks(benchmark, item_id, item_text, max_chunk_words)):
        scan = scanner(rows, window)
        if k:  # a further chunk scans the texts again and adds to what was found
            state = materialize(state, "decontam")
            state = map_columns(state, lambda ids, texts, _, hits, items, scan=scan: (ids, texts, *joined(scan(texts), hits, items)), fields)
        else:
            state = map_columns(state, lambda ids, texts, scan=scan: (ids, texts, *scan(texts)), fields)
    return state


def joined(new: tuple, hits: list, items: list) -> tuple:
    n_words, more_hits, more_items = new
    return n_words, [sorted({*a, *b}) for a, b in zip(hits, more_hits, strict=True)], [sorted({*a, *b}) for a, b in zip(items, more_items, strict=True)]


def scanner(rows: DataFrame, window: int):
    """A function from texts to (n_words, hits, items), with the benchmark rows in a broadcast of bounded size."""
    held = rows.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows.collect()])

    def scan(texts):
        machine = held.__dict__.get("machine")  # built once in each Python worker
        if machine is None:
            machine = held.__dict__["machine"] = Scanner(held.value, window)
        n_words, hits, items = [], [], []
        for text in texts:
            words = alnum_words(text)
            at, who = machine.scan(words)
            n_words.append(len(words))
            hits.append(at)
            items.append(sorted(who))
        return n_words, hits, items

    return scan


def hit_spans(text: str | None, hits: list[int]) -> list[tuple[int, int]]:
    """Character ranges of the original text that cover runs of hit words."""
    starts = [m.span() for m in WORD.finditer(text or "")] if hits else []
    spans: list[list[int]] = []
    for k in hits:
        if spans and spans[-1][2] == k - 1:
            spans[-1][1:] = [starts[k][1], k]
        else:
            spans.append([*starts[k], k])
    return [(a, b) for a, b, _ in spans]


def uncontaminated(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, max_chunk_words: int = MAX_CHUNK_WORDS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns only."""
    out = documents
    for k, rows in enumerate(chunks(benchmark, "item_id", "text", max_chunk_words)):
        if k:
            out = materialize(out, "decontam")  # one automaton in a worker at a time
        out = out.where(~hit_udf(scanner(rows, window))(F.col(text)))
    return out


def hit_udf(scan):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pd.Series([len(at) > 0 for at in scan(texts)[1]], dtype=bool)

    return hit


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP4_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, d.size, item_id FROM doc_windows d JOIN windows x USING (win, size)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""
