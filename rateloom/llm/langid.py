"""Language identification by interpolated Kneser-Ney character language models.

Letters are lower-cased and mapped to 64 classes: 0 for a run of anything that is no letter (and the text's edges),
1 to 26 for a to z, the others by code point modulo 37. So a 4-gram is a 24-bit number, lower orders are its low bits,
and a language's tables are bounded (2^24 4-grams) however large the corpus is.

Every 4-gram of every training document is counted, in the Arrow batches first and by a group-by over (language,
4-gram) then. From the counts, orders 4 to 1 are interpolated with absolute discounts n1 / (n1 + 2 n2); orders below
the fourth count the distinct characters that precede (Kneser-Ney). The fourth order is one sorted array of hashed
4-grams (an odd multiplication modulo 2^24, which collides for none) with a row of log-probabilities, one for each
language; lower orders and back-off weights are dense. A text's score for a language is the mean cost of its
characters, and the language with the lowest cross-entropy is chosen.

Rejection is calibrated on one in `CALIBRATION` of the labelled documents, which are not counted in any model: a
histogram of the margins between the two lowest cross-entropies gives the share of right predictions by margin (made
monotone), which is the score, and the largest cross-entropies that `TAIL` of each language's right documents exceed
give limits; beyond its limit a prediction is not `accepted`.

Documents with crc32(doc_id as text) mod 4 = 2 and those without a language are not learned from; no prediction looks
at language, source or id. Whole texts are read.

Defined results: a null text, or one without a letter, is `und` with score 0 and not accepted; without any training
document all are; a language that no calibration document has right accepts none, and without any such document the
score is one over the number of languages; ties go to the first language by code point; repeated rows are predicted alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.llm.arrow import map_columns, struct
from rateloom.session import materialize, table

FOLDS = 4
HELD = 2
#: One in so many labelled documents calibrates and is not counted.
CALIBRATION = 8
TAIL = 0.001
MARGIN_BINS = 64
HASH = 0x9E3779B1 % (1 << 24) | 1
FLUSH_CHARS = 4 << 20
UNKNOWN = "und"


def checksum(doc_id: Column) -> Column:
    """crc32(doc_id as text); a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4."""
    return F.pmod(checksum(doc_id), F.lit(FOLDS))


def calibrates(doc_id: Column) -> Column:
    """Whether a labelled document is kept for calibration; independent of the fold, and false for a null id."""
    return F.pmod(F.shiftright(checksum(doc_id), 2), F.lit(CALIBRATION)) == CALIBRATION - 1


def classes() -> np.ndarray:
    """Class of each code point; made once in a worker."""
    made = sys.__dict__.get("_rateloom_classes")
    if made is None:
        made = np.zeros(0x110000, np.uint8)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.int64)
        made[letters] = 27 + letters % 37
        made[97:123] = np.arange(1, 27)
        sys.__dict__["_rateloom_classes"] = made
    return made


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of the texts one after the other, and where each text begins (n + 1 places)."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    code = classes()[np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint32)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # each text ends in one blank of its own; runs of blanks count once, and none stands at the beginning
    before = np.concatenate([[np.uint32(0)], code[:-1]])
    before[ends[:-1]] = 0
    keep = (code != 0) | (before != 0)
    code, owner = code[keep], owner[keep]
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    place = np.arange(len(code)) - starts[owner]
    key = code.copy()
    for k in (1, 2, 3):
        past = np.concatenate([np.zeros(k, np.uint32), code[:-k]])[: len(code)]
        key |= np.where(place >= k, past, np.uint32(0)) << np.uint32(6 * k)
    return key, starts


def batches_of(texts: list[str]):
    """Ranges of texts of a few million characters each."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > FLUSH_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of training (text, lang)."""

    def run(texts, langs):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[str, list[str]] = {}
        for t, lang in zip(texts, langs, strict=True):
            by.setdefault(lang, []).append(t or "")
        for lang, some in by.items():
            for a, b in batches_of(some):
                key, n = np.unique(grams(some[a:b])[0], return_counts=True)
                if lang in total:
                    key, back = np.unique(np.concatenate([total[lang][0], key]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([total[lang][1], n]).astype(float)).astype(np.int64)
                total[lang] = key, n
        names = [lang for lang, (key, _) in total.items() for _ in range(len(key))]
        none = np.empty(0, np.int64)
        return names, np.concatenate([k for k, _ in total.values()] or [none]).astype(np.int64), np.concatenate([n for _, n in total.values()] or [none])

    return map_columns(training, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def smoothed(key: np.ndarray, count: np.ndarray, lower: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities of the seen grams, and the back-off weight of each context. lower: by the low bits."""
    d = discount(count)
    context = key >> 6
    total = np.bincount(context, count, 1 << (bits - 6))
    kinds = np.bincount(context, minlength=1 << (bits - 6))
    weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    p = np.maximum(count - d, 0) / total[context] + weight[context] * lower[key & ((1 << (bits - 6)) - 1)]
    return p, weight


def continuations(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams one shorter, with the number of distinct characters before them."""
    return np.unique(key & ((1 << (bits - 6)) - 1), return_counts=True)


@dataclass
class LanguageModels:
    langs: list[str]
    hashes: np.ndarray  # sorted
    cost4: np.ndarray  # a row for each hash, a column for each language
    cost3: np.ndarray  # by 3-gram
    back4: np.ndarray  # by context of three

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, and whether it has a letter."""
        out, letters = np.full((len(texts), len(self.langs)), np.nan), np.zeros(len(texts), bool)
        for a, b in batches_of(texts):
            key, starts = grams(texts[a:b])
            some = np.diff(starts) > 0
            letters[a:b] = some
            if not len(key):
                continue
            hashed = key * np.uint32(HASH) & np.uint32(0xFFFFFF)
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            seen = self.hashes[at] == hashed
            begins = starts[:-1][some]
            for k in range(len(self.langs)):
                cost = np.where(seen, self.cost4[k][at], 0).astype(np.float64)
                new = key[~seen]
                cost[~seen] = self.back4[k][new >> 6] + self.cost3[k][new & 0x3FFFF]
                out[a:b, k][some] = np.add.reduceat(cost, begins) / np.diff(starts)[some]
        return out, letters


def train(counts: pd.DataFrame) -> LanguageModels:
    """counts: lang, gram, n."""
    langs = sorted(counts["lang"].unique(), key=lambda s: s.encode())
    tables = {lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for lang, g in counts.sort_values(["lang", "gram"]).groupby("lang")}
    union = np.unique(np.concatenate([k for k, _ in tables.values()]))
    cost4, cost3, back4 = [], [], []
    for lang in langs:
        key4, n4 = tables[lang]
        key3, n3 = continuations(key4, 24)
        key2, n2 = continuations(key3, 18)
        key1, n1 = continuations(key2, 12)
        p1 = np.full(64, 1 / 64)
        seen, weight = smoothed(key1, n1, np.array([1 / 64]), 6)
        p1 *= weight[0]
        p1[key1] = seen
        p2 = _dense(key2, n2, p1, 12)
        p3 = _dense(key3, n3, p2, 18)
        seen, weight = smoothed(key4, n4, p3, 24)
        row = weight[union >> 6] * p3[union & 0x3FFFF]
        row[np.searchsorted(union, key4)] = seen
        cost4.append(-np.log2(row).astype(np.float32))
        cost3.append(-np.log2(p3).astype(np.float32))
        back4.append(-np.log2(weight).astype(np.float32))
    hashes = union.astype(np.uint32) * np.uint32(HASH) & np.uint32(0xFFFFFF)
    order = np.argsort(hashes)
    return LanguageModels(langs, hashes[order], np.array(cost4)[:, order], np.array(cost3), np.array(back4))


def _dense(key: np.ndarray, count: np.ndarray, lower: np.ndarray, bits: int) -> np.ndarray:
    """Probabilities of all grams of so many bits."""
    seen, weight = smoothed(key, count, lower, bits)
    every = np.arange(1 << bits)
    p = weight[every >> 6] * lower[every & ((1 << (bits - 6)) - 1)]
    p[key] = seen
    return p


def margin_scores(rows: list[tuple[int, int, int]], langs: int) -> np.ndarray:
    """Share of right predictions by margin bin, made monotone by pooling. rows: (bin, right, all)."""
    blocks: list[list[float]] = []
    right, total = np.zeros(MARGIN_BINS), np.zeros(MARGIN_BINS)
    for b, r, n in rows:
        right[b], total[b] = r, n
    for b in range(MARGIN_BINS):
        blocks.append([right[b] + 0.5 / langs, total[b] + 0.5, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            r, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), r / n) for r, n, k in blocks])


def margin_bin(margin: Column) -> Column:
    return F.least(F.floor(F.coalesce(margin, F.lit(0.0)) * 32), F.lit(MARGIN_BINS - 1)).cast("int")


def predicted(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, cross_entropy, accepted."""
    spark = documents.sparkSession
    held_out = fold(F.col(doc_id)) == HELD
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out.alias("held_out"))
    labelled = ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    counts = gram_counts(rows.where(labelled & ~calibrates(F.col("doc_id"))).select("text", "lang")).toPandas()  # 2^24 a language at most
    fields = struct(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang string, lang_pred string, cross_entropy double, margin double")
    if not len(counts):
        none = rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))
        return none
    models = spark.sparkContext.broadcast(train(counts))

    def score(ids, texts, langs, held):
        m = models.value
        cost, letters = m.costs([t or "" for t in texts])
        if not len(texts):
            return [], [], [], [], [], []
        best = np.where(letters, np.nan_to_num(cost, nan=np.inf).argmin(axis=1), -1)
        two = np.partition(cost, 1, axis=1) if cost.shape[1] > 1 else np.repeat(cost, 2, axis=1) + [0, 1]
        names = [m.langs[b] if b >= 0 else UNKNOWN for b in best]
        clean = lambda x: [float(v) if ok else None for v, ok in zip(x, letters, strict=True)]
        return ids, held, langs, names, clean(two[:, 0]), clean(two[:, 1] - two[:, 0])

    scored = materialize(map_columns(rows, score, fields), "lang_scored")
    known = scored.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("margin").isNotNull() & calibrates(F.col("doc_id")))
    right = (F.col("lang") == F.col("lang_pred")).cast("long")
    bins = known.groupBy(margin_bin(F.col("margin")).alias("bin")).agg(F.sum(right).alias("right"), F.count("*").alias("n")).collect()
    shares = margin_scores([(r["bin"], r["right"], r["n"]) for r in bins], len(models.value.langs))
    grid = known.where(right == 1).groupBy("lang", F.floor(F.col("cross_entropy") * 64).alias("bin")).agg(F.count("*").alias("n")).collect()
    limits: dict[str, float] = {}
    for name in models.value.langs:
        tail, left = 0, sorted(((r["bin"], r["n"]) for r in grid if r["lang"] == name), reverse=True)
        total = sum(n for _, n in left)
        for b, n in left:
            limits[name] = (b + 1) / 64
            tail += n
            if tail > TAIL * total:
                break
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in (limits or {UNKNOWN: 0.0}).items() for x in pair)), F.col("lang_pred"))
    accepted = F.coalesce(F.col("cross_entropy") <= limit, F.lit(False))
    share = F.get(F.array(*(F.lit(float(s)) for s in shares)), margin_bin(F.col("margin")))
    return scored.select("doc_id", "held_out", "lang_pred", F.when(F.col("margin").isNull(), 0.0).otherwise(share).alias("score"), "cross_entropy", accepted.alias("accepted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(table(spark, sf_dir, "documents"))
