"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier.

Lexicon. From a bounded, documented sample of labelled rows (`MAX_LABELLED`, a share of the hash space of the ids), of
which one text of each family of near copies teaches, the words and word beginnings (3 to 8 characters) that go with
the label are mined: those in at least three toxic texts whose smoothed log-odds are clear of chance. The `LEXICON`
strongest are the features of the model.

Voters. The lexicon is dealt to twelve voters, each of which votes if one of its entries occurs; four more vote on
patterns: capitals, runs of exclamation marks, symbols between words, and words said again at once.

Label model. A log-linear model over the 16 votes and the hidden class,
    log p(votes, y) = const + bias . votes + y (prior + strength . votes) + sum over pairs (j, k) of c_jk votes_j votes_k,
gives each voter its accuracy (strength) and each correlated pair of voters its correlation (c_jk), so that two voters
that see the same thing do not count twice. Pairs enter where the independent model misses their joint frequency most,
at most `MAX_PAIRS` of the 120.
It is fitted by gradient steps on the likelihood of the counts of vote patterns over all training documents, of which
there are 2^16 at most; on labelled ones the label is one voter more, with accuracy `LABEL_ACCURACY`.

Classifier. Logistic regression on lexicon entries and patterns, trained on the posterior labels of the sample.

Labels are learned only from documents whose crc32(doc_id as text) mod 5 is not 0; no score looks at labels, language,
source or id. Whole texts are read.

Defined results: null and empty texts have no votes and are scored by the intercept; without labelled rows of both
classes the score is the labelled share of toxic rows (0 without any); null labels are ignored, of repeated labels the
largest holds; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.llm.arrow import lower_space_words, map_columns
from rateloom.session import materialize, table

MAX_LABELLED = 20_000
LEXICON = 1024
LEXICON_VOTERS = 12
LEAST_COUNT = 3
LEAST_Z = 2.5
LABEL_ACCURACY = 0.95
MAX_PAIRS = 24
PREFIXES = range(3, 9)
#: Near copies in the sample agree in all minima of one of so many bands of so many hash functions.
FAMILY_BANDS, FAMILY_ROWS = 3, 2
FOLDS = 5
TOKEN = re.compile(r"\w+")
BANG = re.compile(r"!!")
MARKED = re.compile(r"[#*$%&|]{1,3}(?=\s)")


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def entries(text: str | None) -> set[str]:
    """Words and, with a star, their beginnings."""
    words = set(TOKEN.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def patterns(text: str | None) -> list[bool]:
    text = text or ""
    size = max(len(text), 1)
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:]))
    capitals = sum(map(str.isupper, words))
    return [
        capitals * 2 > max(len(words), 1), len(BANG.findall(text)) * 100 > size,
        len(MARKED.findall(text)) * 4 > max(len(words), 1), again * 4 > max(len(words), 1),
    ]


def spotted(text: str | None, lexicon: dict[str, int]) -> list[int]:
    """Numbers of the lexicon's entries in the text, then those of its patterns."""
    found = set()
    get = lexicon.get
    for w in set(TOKEN.findall((text or "").lower())):
        if (k := get(w)) is not None:
            found.add(k)
        for n in PREFIXES:
            if n > len(w):
                break
            if (k := get(w[:n] + "*")) is not None:
                found.add(k)
    size = len(lexicon)
    return sorted(found) + [size + k for k, on in enumerate(patterns(text)) if on]


def vote_bits(spots: list[int], size: int) -> int:
    bits = 0
    for k in spots:
        bits |= 1 << (k % LEXICON_VOTERS if k < size else LEXICON_VOTERS + k - size)
    return bits


@dataclass
class LabelModel:
    """p(votes, y) over all patterns of n voters; bits of a pattern are votes."""

    n: int
    bias: np.ndarray
    strength: np.ndarray
    prior: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def votes(self) -> np.ndarray:
        return (np.arange(1 << self.n)[:, None] >> np.arange(self.n) & 1).astype(np.float64)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """P(y = 1 | votes)."""
        votes = (np.asarray(bits)[:, None] >> np.arange(self.n) & 1).astype(np.float64)
        return 1 / (1 + np.exp(-(self.prior + votes @ self.strength)))

    def accuracies(self) -> np.ndarray:
        """P(vote | y) for y = 0 and 1, with the correlations taken into account."""
        votes = self.votes()
        joint = self._joint(votes, self._products(votes))
        return np.array([(joint[:, y] @ votes) / joint[:, y].sum() for y in (0, 1)])

    def _products(self, votes: np.ndarray) -> np.ndarray:
        return votes[:, [j for j, _ in self.pairs]] * votes[:, [k for _, k in self.pairs]]

    def _joint(self, votes: np.ndarray, products: np.ndarray) -> np.ndarray:
        rest = votes @ self.bias + products @ self.weights
        energy = np.stack([rest, rest + self.prior + votes @ self.strength], axis=1)
        joint = np.exp(energy - energy.max())
        return joint / joint.sum()


def climb(model: LabelModel, bits: np.ndarray, counts: np.ndarray, evidence: np.ndarray, steps: int) -> None:
    """Adam on the marginal likelihood. evidence: log-odds that a pattern's label adds, 0 without one."""
    votes, total = model.votes(), counts.sum()
    products = model._products(votes)
    seen_votes, seen_products = votes[bits], products[bits]
    theta = np.concatenate([model.bias, model.strength, [model.prior], model.weights])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = model.n
    for step in range(1, steps + 1):
        model.bias, model.strength, model.prior, model.weights = theta[:n], theta[n : 2 * n], float(theta[2 * n]), theta[2 * n + 1 :]
        q = 1 / (1 + np.exp(-(model.prior + seen_votes @ model.strength + evidence)))
        w = counts / total
        joint = model._joint(votes, products)
        both = joint.sum(axis=1)
        grad = np.concatenate([
            w @ seen_votes - both @ votes, (w * q) @ seen_votes - joint[:, 1] @ votes,
            [w @ q - joint[:, 1].sum()], w @ seen_products - both @ products,
        ]) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / (1 + step / 100)
    model.bias, model.strength, model.prior, model.weights = theta[:n], theta[n : 2 * n], float(theta[2 * n]), theta[2 * n + 1 :]


def fit_label_model(rows: list[tuple[int, int | None, int]], n: int = LEXICON_VOTERS + 4, max_pairs: int = MAX_PAIRS) -> LabelModel:
    """rows: (pattern, label or None, count)."""
    bits = np.array([r[0] for r in rows])
    counts = np.array([r[2] for r in rows], float)
    sure = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    evidence = np.array([0.0 if r[1] is None else sure if r[1] else -sure for r in rows])
    votes = (bits[:, None] >> np.arange(n) & 1).astype(float)
    known = evidence != 0
    on, off = counts * (known & (evidence > 0)), counts * (known & (evidence < 0))
    rate = [(c @ votes + 0.5) / (c.sum() + 1) for c in (off, on)]
    logit = lambda p: np.log(p / (1 - p))
    share = (on.sum() + 0.5) / (on.sum() + off.sum() + 1)
    model = LabelModel(n, logit(rate[0]), logit(rate[1]) - logit(rate[0]), float(logit(share) + np.log((1 - rate[1]) / (1 - rate[0])).sum()))
    climb(model, bits, counts, evidence, 150)
    # pairs whose joint frequency the independent model misses
    all_votes = model.votes()
    both = model._joint(all_votes, model._products(all_votes)).sum(axis=1)
    expected = (all_votes * both[:, None]).T @ all_votes
    seen = (votes * counts[:, None]).T @ votes / counts.sum()
    z = np.abs(seen - expected) / np.sqrt(np.maximum(expected, 1 / counts.sum()) / counts.sum())
    ranked = sorted(((z[j, k], j, k) for j in range(n) for k in range(j + 1, n)), reverse=True)[:max_pairs]
    model.pairs = [(j, k) for value, j, k in ranked if value > 3]
    model.weights = np.zeros(len(model.pairs))
    climb(model, bits, counts, evidence, 300)
    return model


def logistic(rows: list[tuple[list[int], float, float]], size: int, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept on sparse binary features; rows: (features, target in 0..1, weight). Adam on the whole sample."""
    where = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    cols = np.array([k for r in rows for k in r[0]], np.int64)
    target, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    total = weight.sum()
    share = np.clip((weight @ target) / total, 1e-3, 1 - 1e-3)
    theta = np.zeros(size + 1)
    theta[size] = np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 401):
        margin = np.bincount(where, theta[cols], len(rows)) + theta[size]
        error = weight * (1 / (1 + np.exp(-margin)) - target)
        grad = np.append(np.bincount(cols, error[where], size) + ridge * theta[:size], error.sum()) / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / (1 + step / 200)
    return theta[:size], float(theta[size])


@dataclass
class ToxicityModel:
    lexicon: dict[str, int]
    weights: np.ndarray
    intercept: float
    labels: LabelModel | None = None

    def score(self, spots: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + sum(self.weights[k] for k in spots), -40, 40))))


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int, doc_id: str, text: str) -> DataFrame:
    """text and toxic of at most about max_labelled labelled training ids."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(max_labelled / n * 1_000_000))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(known), "doc_id").select("text", "toxic")  # the ids are bounded by the parameter


def minima(text: str | None) -> list[int]:
    """A key for each band of least hashes of the 5-word shingles."""
    words = lower_space_words(text)
    grams = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    h = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
    odd = np.random.default_rng(3).integers(1, 1 << 63, size=FAMILY_BANDS * FAMILY_ROWS, dtype=np.uint64) | np.uint64(1)
    least = [int((h * m ^ (h >> np.uint64(29)) * (m + np.uint64(2))).min()) for m in odd]
    return [xxhash.xxh64_intdigest(repr(least[k :: FAMILY_BANDS])) - (1 << 63) for k in range(FAMILY_BANDS)]


def one_of_each_family(sample: DataFrame) -> DataFrame:
    """Of near copies the first one: a text with a thousand near copies must not teach a thousand times.

    Texts are taken for copies if both minima of a band agree: 99 % of those with a Jaccard similarity of 0.9 over
    five-word shingles, 58 % of those with 0.5, 11 % of those with 0.2 (by the formula 1 - (1 - s^2)^3).
    """
    rows = map_columns(sample, lambda texts, toxic: (texts, toxic, [minima(t) for t in texts]), "text string, toxic int, least array<long>")
    for k in range(FAMILY_BANDS):
        rows = rows.groupBy(F.get("least", F.lit(k)).alias("family"), "toxic").agg(F.min(F.struct("text", "least")).alias("first")).select("first.text", "toxic", "first.least")
    return rows.select("text", "toxic")


def mined(sample: DataFrame, size: int) -> dict[str, int]:
    """The strongest entries, numbered by strength."""

    def tally(wanted):
        def run(texts, toxic):
            n: dict[str, list[int]] = {}
            for t, y in zip(texts, toxic, strict=True):
                if wanted is not None or y:
                    for e in entries(t) if wanted is None else entries(t) & wanted.value:
                        n.setdefault(e, [0, 0])[y] += 1
            return list(n), [x[0] for x in n.values()], [x[1] for x in n.values()]

        return map_columns(sample, run, "entry string, off long, on long").groupBy("entry").agg(F.sum("off").alias("off"), F.sum("on").alias("on"))

    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return {}
    often = tally(None).where(F.col("on") >= LEAST_COUNT)  # of the bounded sample's toxic texts
    wanted = sample.sparkSession.sparkContext.broadcast({r["entry"] for r in often.collect()})
    ranked = []
    for r in tally(wanted).collect():
        on, off = r["on"] + 0.5, r["off"] + 0.5
        odds = np.log(on / (total[1] + 1 - on)) - np.log(off / (total[0] + 1 - off))
        z = odds / np.sqrt(1 / on + 1 / off)
        if z >= LEAST_Z and odds >= 2:
            ranked.append((-on * odds, r["entry"]))
    return {e: k for k, (_, e) in enumerate(sorted(ranked)[:size])}


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    sample = materialize(one_of_each_family(labelled_sample(documents, labels, max_labelled, doc_id, text)), "tox_sample")
    lexicon = mined(sample, LEXICON)
    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        share = 1.0 if total.get(1) else 0.0
        return ToxicityModel({}, np.zeros(4), 40.0 if share else -40.0)
    held, size = documents.sparkSession.sparkContext.broadcast(lexicon), len(lexicon)

    def spots(texts):
        return [spotted(t, held.value) for t in texts]

    def seen(texts, toxic):
        found = spots(texts)
        return found, [vote_bits(s, size) for s in found], toxic

    spotted_sample = map_columns(sample, seen, "spots array<int>, bits int, toxic int").groupBy("spots", "bits", "toxic").agg(F.count("*").alias("n"))
    rows = spotted_sample.collect()  # of the bounded sample
    train = documents.where(fold(F.col(doc_id)) != 0).select(F.col(text).alias("text"))
    unlabelled = map_columns(train, lambda texts: ([vote_bits(s, size) for s in spots(texts)],), "bits int").groupBy("bits").count().collect()  # 2^16 at most
    votes: dict[tuple[int, int | None], int] = {(r["bits"], None): r["count"] for r in unlabelled}
    for r in rows:
        votes[r["bits"], r["toxic"]] = votes.get((r["bits"], r["toxic"]), 0) + r["n"]
        votes[r["bits"], None] = max(0, votes.get((r["bits"], None), 0) - r["n"])
    model = fit_label_model([(b, y, n) for (b, y), n in sorted(votes.items(), key=str) if n])
    bits, toxic = np.array([r["bits"] for r in rows]), np.array([r["toxic"] for r in rows])
    p = np.clip(model.posterior(bits), 1e-6, 1 - 1e-6)
    sure = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    target = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.where(toxic == 1, sure, -sure))))
    weights, intercept = logistic([(r["spots"], t, r["n"]) for r, t in zip(rows, target.tolist(), strict=True)], size + 4)
    return ToxicityModel(lexicon, weights, intercept, model)


def score_udf(spark: SparkSession, model: ToxicityModel):
    """A column function from texts to scores."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(spotted(t, m.lexicon)) for t in texts], dtype=float)

    return score


def toxicity(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    score = score_udf(documents.sparkSession, fit(documents, labels, doc_id=doc_id, text=text, max_labelled=max_labelled))
    found = documents.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 0).alias("held_out"), score(F.col(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
