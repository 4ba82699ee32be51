"""Quality rules and robust multivariate outliers by minimum covariance determinants per language and source.

Base rules count words, symbols, repeated lines and repeated 5-word windows of the whole text. The documents that pass
them give a vector of transformed statistics:
    ln(characters per word), sqrt(symbols per character), sqrt(repeated lines per line),
    sqrt(repeated words per word), ln(words).
For each (lang, source) the minimum covariance determinant estimate is the mean and covariance of the `ALPHA` share of
its documents with the smallest determinant. Concentration steps find it: estimate mean and covariance of the subset,
take the documents with the smallest Mahalanobis distances as the next subset, repeat until no group's determinant falls
by more than a thousandth below its lowest. They run from `STARTS` deterministic starts at once (distances from medians in quartile
ranges: their squared sum, their largest, and their squared sum without the length), and each group keeps the start that
ends at the smallest determinant.

The covariance is regularised by a floor on each statistic's spread, for most texts have no symbol and no repeated line
at all. FLOORS are the smallest spreads that mean something: 5 % of a word's length, one symbol in 2,500 characters, one
repeated line in eleven, one repeated window (ten words) in 250 words, a factor of 1.65 in length. Distances are scaled
so that neither their median nor their `ALPHA` quantile exceeds that of a chi-square with five degrees of freedom; the
cutoff is that chi-square's quantile at which fewer than one in a corpus of 1 / `FAMILYWISE` clean documents is rejected.
Neither looks at any label. A statistic may be unable to reject by itself: with the scale s of its group (in the result),
all lines repeated add 11 s, and a text e^n times the usual length adds 4 n^2 s.

Every step runs over all documents and gathers only sums: moments by group, and histograms of distances on a grid of
1/64 in the logarithm (the subset takes whole bins, so it is the share or slightly more; a step may then raise a
determinant slightly, and the last is taken). Groups of fewer than `MIN_GROUP` documents, five for each dimension, can't
bear an estimate of their own: they share one by language, and those that are still fewer one for the rest; if that is
smaller yet, nothing is rejected by distance. A warning tells if `MAX_STEPS` are not enough.

Defined results: null and empty texts have zero counts and fail the base rules; null languages and sources are groups
of their own; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateloom.llm.arrow import encoded, map_columns
from rateloom.session import materialize, table

ALPHA = 0.75
DIM = 5
MIN_GROUP = 5 * DIM
MAX_STEPS = 30
STARTS = 3
FAMILYWISE = 1e-11
#: The least spread of each statistic that counts as one.
FLOORS = (0.05, 0.02, 0.3, 0.2, 0.5)
#: Characters that count as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = "n_words long, word_chars long, n_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def chi_square(tail: float) -> float:
    """The value that a chi-square with five degrees of freedom exceeds with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > tail else (low, x)
    return low


CUTOFF = chi_square(FAMILYWISE)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; windows are compared exactly."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    key, distinct = ids[:n], len(number)
    for k in range(1, window):
        if distinct * len(number) >= 1 << 62:  # number the pieces anew
            _, key = np.unique(key, return_inverse=True)
            distinct = int(key.max()) + 1
        key, distinct = key * len(number) + ids[k : k + n], distinct * len(number)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = encoded(text).split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), len(text), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(words),
    )


def counted(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    base = documents.select(*(F.col(c).alias(a) for c, a in ((doc_id, "doc_id"), (lang, "lang"), (source, "source"), (text, "text"))))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[:3]) + ", " + COUNTS
    rows = map_columns(base, lambda ids, langs, sources, texts: (ids, langs, sources, *(zip(*map(text_counts, texts), strict=True) if texts else [[]] * 7)), fields)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def statistics() -> list[Column]:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return [
        F.ln(F.greatest("word_chars", F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / F.greatest("n_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.ln(words),
    ]


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
FIT = T.StructType([T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType())), T.StructField("logdet", T.DoubleType())])


@F.pandas_udf(FIT)
def estimate(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
    """Mean, inverse and log-determinant of the regularised covariance, from a group's moments."""
    out = []
    for k, s, p in zip(n, sums, products, strict=True):
        mean = np.asarray(s) / k
        cov = np.empty((DIM, DIM))
        for (i, j), value in zip(PAIRS, p, strict=True):
            cov[i, j] = cov[j, i] = value / k - mean[i] * mean[j]
        cov += np.diag(np.square(FLOORS))
        out.append((mean, np.linalg.inv(cov).ravel(), float(np.linalg.slogdet(cov)[1])))
    return pd.DataFrame(out, columns=["mean", "inverse", "logdet"])


def fitted(rows: DataFrame) -> DataFrame:
    """Moments of each group in one pass, and the estimate from them."""
    moments = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.array(*(F.sum(x) for x in X)).alias("sums"),
        F.array(*(F.sum(F.col(X[i]) * F.col(X[j])) for i, j in PAIRS)).alias("products"),
    )
    return materialize(moments.select("key", "n", estimate("n", "sums", "products").alias("fit")).select("key", "n", "fit.*"), "mcd_fit")


def mahalanobis() -> Column:
    d = [F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(X)]
    terms = [d[i] * d[j] * F.get("inverse", F.lit(i * DIM + j)) * (1 if i == j else 2) for i, j in PAIRS]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


def bin_of(value: Column) -> Column:
    return F.floor(F.ln(value + F.lit(1e-9)) * 64).cast("long")


def quantile_bins(rows: DataFrame, share: float) -> DataFrame:
    """For each key the smallest bin up to which the share of its rows lies."""
    counts = rows.groupBy("key", "bin").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(Window.partitionBy("key")))
    return materialize(cum.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("key").agg(F.min("bin").alias("limit")), "mcd_limit")


def start_distances(rows: DataFrame) -> DataFrame:
    """Squared distances from the medians, in quartile ranges, on a grid of 1/256."""
    long = rows.select("key", F.posexplode(F.array(*(F.floor(F.col(x) * 256) for x in X))).alias("dim", "bin"))
    counts = long.groupBy("key", "dim", "bin").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("key", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(Window.partitionBy("key", "dim")))
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))) / 256
    spread = cum.groupBy("key", "dim").agg(at(0.5).alias("median"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    wide = spread.groupBy("key").agg(
        *(F.max(F.when(F.col("dim") == i, F.col("median"))).alias(f"m{i}") for i in range(DIM)),
        *(F.max(F.when(F.col("dim") == i, F.greatest("spread", F.lit(FLOORS[i])))).alias(f"s{i}") for i in range(DIM)),
    )
    parts = [F.pow((F.col(X[i]) - F.col(f"m{i}")) / F.col(f"s{i}"), 2) for i in range(DIM)]
    total = lambda some: reduce(lambda a, b: a + b, some)
    starts = F.posexplode(F.array(bin_of(total(parts)), bin_of(F.greatest(*parts)), bin_of(total(parts[:-1])))).alias("start", "bin")
    return rows.join(materialize(wide, "mcd_start"), "key").select("key", *X, starts).select(attempt("start"), *X, "bin")


def attempt(start: str) -> Column:
    """The group's key with the number of the start."""
    return F.concat(F.coalesce("key", F.lit("")), F.lit("#"), F.col(start).cast("string")).alias("key")


def outlier_distances(vectors: DataFrame, *, alpha: float = ALPHA, max_steps: int = MAX_STEPS) -> tuple[DataFrame, DataFrame]:
    """vectors: key (not null), x0.. x4. Gives the estimates by key (mean, inverse, n, logdet) and the factor that scales distances."""
    rows = start_distances(vectors)
    tried = vectors.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).select(attempt("start"), *X)
    before = None
    for _ in range(max_steps):
        subset = rows.join(quantile_bins(rows, alpha), "key").where("bin <= limit")
        fit = fitted(subset)
        if before is not None:
            fall = fit.select("key", "logdet").join(before, "key").agg(F.max(F.col("old") - F.col("logdet"))).first()[0]
            if fall is None or fall < 1e-3:
                break
        rows = tried.join(fit.select("key", "mean", "inverse"), "key").select("key", *X, bin_of(mahalanobis()).alias("bin"))
        lowest = fit.select("key", F.col("logdet").alias("old"))  # whole bins may let a group swing: what counts is a new minimum
        before = lowest if before is None else materialize(lowest.union(before).groupBy("key").agg(F.min("old").alias("old")), "mcd_lowest")
    else:
        warnings.warn(f"concentration steps did not converge within {max_steps}", stacklevel=2)
    own = F.regexp_replace("key", "#[0-9]+$", "")
    best = fit.groupBy(own.alias("key")).agg(F.min(F.struct("logdet", "n", "mean", "inverse")).alias("b")).select("key", "b.*")
    best = materialize(best, "mcd_best")
    rows = vectors.join(best.select("key", "mean", "inverse"), "key").select("key", *X, bin_of(mahalanobis()).alias("bin"))
    factor = lambda share: quantile_bins(rows, share).select("key", (F.lit(chi_square(1 - share)) / F.exp((F.col("limit") + 1) / 64)).alias(f"at{share * 100:.0f}"))
    scale = factor(0.5).join(factor(alpha), "key").select("key", F.least("at50", f"at{alpha * 100:.0f}").alias("scale"))
    return best, scale


def keyed_by_group(rows: DataFrame, min_group: int) -> DataFrame:
    """rows with `key`: language and source, or the language where those are too few, or the rest."""
    passed = rows.where(~F.col("base_failed"))
    own = F.to_json(F.struct("lang", "source"))
    wide = F.to_json(F.struct("lang"))
    sizes = materialize(passed.groupBy(own.alias("own")).agg(F.count("*").alias("n_own")), "quality_groups")
    named = rows.withColumns({"own": own, "wide": wide}).join(sizes, "own", "left")
    few = F.coalesce(F.col("n_own") < min_group, F.lit(True))
    left = named.where(~F.col("base_failed") & few).groupBy("wide").agg(F.count("*").alias("n_wide"))
    named = named.join(materialize(left, "quality_languages"), "wide", "left")
    return named.withColumn("key", F.when(~few, F.col("own")).when(F.col("n_wide") >= min_group, F.col("wide")).otherwise(F.lit("rest")))


def quality(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
            cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """A row per document: the counts, base_failed, distance and its scale (null where there is no estimate) and kept."""
    rows = materialize(counted(documents, doc_id=doc_id, text=text, lang=lang, source=source), "quality_counts")
    keyed = keyed_by_group(rows, min_group)
    keyed = materialize(keyed.select("doc_id", *rows.columns[3:], "key", *(x.alias(n) for x, n in zip(statistics(), X, strict=True))), "quality_vectors")
    fit, scale = outlier_distances(keyed.where(~F.col("base_failed")).select("key", *X))
    judged = keyed.join(fit.where(F.col("n") >= min_group * ALPHA).join(scale, "key"), "key", "left")
    judged = judged.withColumn("distance", mahalanobis() * F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select("doc_id", *rows.columns[3:], "distance", "scale", kept.alias("kept"))


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
