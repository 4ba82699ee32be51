"""Feature spaces and groups: standardising, distances, medoids, silhouettes, layouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateloom.functions import arrays as A
from rateloom.functions import kernels

#: Rows that meet in a task, on either side, and spaces whose counts are broadcast.
CHUNK = 8192
BROADCAST_SPACES = 100_000


def standardized(df: DataFrame, vector: str, size: int) -> DataFrame:
    """z-scores by the population deviation of each component; constant ones become 0. One aggregate row is broadcast."""
    stats = df.agg(
        F.array(*(F.avg(F.get(vector, F.lit(i))) for i in range(size))).alias("_m"),
        F.array(*(F.stddev_pop(F.get(vector, F.lit(i))) for i in range(size))).alias("_s"))
    z = F.zip_with(F.zip_with(vector, "_m", lambda v, m: v - m), "_s", lambda d, s: F.when(s > 1e-12, d / s).otherwise(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(vector, z).drop("_m", "_s")


def group_means(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    return df.groupBy(group).agg(F.array(*(F.avg(F.get(vector, F.lit(i))) for i in range(size))).alias("center"), F.count("*").alias("n"))


def mean_pairwise_square(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Mean squared distance of all pairs, from variances alone: 2 n / (n - 1) times their sum; fewer than two rows give 0."""
    total = sum((F.var_pop(F.get(vector, F.lit(i))) for i in range(1, size)), F.var_pop(F.get(vector, F.lit(0))))
    n = F.count("*")
    return df.agg(F.when(n > 1, 2 * n * total / (n - 1)).otherwise(0.0).alias("mean_square"))


def unmeasured(vector: str) -> Column:
    return F.col(vector).isNull() | F.exists(vector, F.isnull)


def distance_parts(df: DataFrame, key: str, group: str, vector: str, weight: str | None = None, across: bool = False) -> DataFrame:
    """(key, group, other, total, n): sums of (weighted) distances to the rows of group `other`, in parts to be summed.

    Rows are dealt by their key into chunks, and each two chunks meet in a task, once for both directions. Groups are
    apart, with all pairs; across: all rows meet, but for pairs of one key. Only vectors of one length have distances.
    """
    kind = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()
    rows = df.where(~unmeasured(vector)).select(
        F.col(key).alias("key"), F.col(group).alias("group"), F.col(vector).alias("x"), F.size(vector).alias("size"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    space = ["size"] if across else ["size", "group"]
    counts = rows.groupBy(*space).agg(F.count("*").alias("rows"))
    spaces, n = counts.agg(F.count("*"), F.sum("rows")).first()
    chunk = min(CHUNK, max(256, (n or 0) // 16))
    counts = counts.select(*(F.col(c).alias(f"of_{c}") for c in space), F.ceil(F.col("rows") / chunk).cast("int").alias("chunks"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in space]
    dealt = rows.join(F.broadcast(counts) if spaces <= BROADCAST_SPACES else counts, same)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", "group", "x", "w", "size", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), (F.col("chunk") <= F.col("with")).alias("first"))

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        column = {c: part[c].combine_chunks() for c in part.column_names}
        x = column["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
        w = column["w"].to_numpy(zero_copy_only=False)
        known = ~np.isnan(w)
        w = np.where(known, w, 0.0)
        code, ids = (column[c].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in ("group", "key"))
        first = column["first"].to_numpy(zero_copy_only=False)
        alone = column["low"][0].as_py() == column["high"][0].as_py()
        sides = (np.arange(len(x)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
        left, right = (side[np.argsort(code[side], kind="stable")] for side in sides)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, np.int64))]
        if len(left) and len(right):
            heads = lambda c: np.flatnonzero(np.r_[True, np.diff(c) != 0])
            starts, ends = heads(code[right]), heads(code[left])
            back = np.zeros((len(ends), len(right)))
            strip = max(1, (1 << 20) // len(right))
            for at in range(0, len(left), strip):
                mine = left[at : at + strip]
                d = kernels.distances(x[mine], x[right])
                n = np.tile(np.add.reduceat(known[right].astype(np.int64), starts), (len(mine), 1))
                if alone and across:
                    i, j = np.nonzero(ids[mine][:, None] == ids[right])
                    d[i, j] = 0.0
                    np.subtract.at(n, (i, np.searchsorted(starts, j, "right") - 1), known[right][j])
                total = np.add.reduceat(d * w[right], starts, axis=1)
                out.append((np.repeat(mine, len(starts)), np.tile(right[starts], len(mine)), total.ravel(), n.ravel()))
                if not alone:
                    at_heads = heads(code[mine])
                    back[np.searchsorted(code[left][ends], code[mine][at_heads])] += np.add.reduceat(d * w[mine][:, None], at_heads, axis=0)
            if not alone:
                n = np.add.reduceat(known[left].astype(np.int64), ends)
                out.append((np.repeat(right, len(ends)), np.tile(left[ends], len(right)), back.T.ravel(), np.tile(n, len(right))))
        who, whose, total, n = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"key": column["key"].take(pa.array(who)), "group": column["group"].take(pa.array(who)), "other": column["group"].take(pa.array(whose)), "total": total, "n": n})

    parts = dealt.groupBy(*space, "low", "high").applyInArrow(run, f"key {kind[0]}, group {kind[1]}, other {kind[1]}, total double, n long")
    none = df.where(unmeasured(vector)).select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(group).alias("other"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))
    return parts.union(none)


def distance_sums(df: DataFrame, key: str, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """For each row the (weighted) sum of distances to its group's rows; rows without a group have none."""
    parts = distance_parts(df.where(F.col(group).isNotNull()), key, group, vector, weight)
    return parts.groupBy(F.col("key").alias(key), F.col("group").alias(group)).agg(F.when(F.sum("n") > 0, F.sum("total")).alias("total"))


def medoids(df: DataFrame, key: str, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """Of each group the row with the least sum of distances; the lower key wins ties (sums are compared at 9 digits)."""
    w = F.count("*") if weight is None else F.sum(weight)
    copies = df.groupBy(group, vector).agg(F.min(key).alias(key), w.cast("double").alias("_w"))  # equal vectors, one sum
    sums = distance_sums(copies, key, group, vector, "_w")
    tie = F.floor(F.col("total") * 1e9 + 0.5)
    order = F.struct(tie.isNull().alias("none"), tie.alias("t"), F.col(key).alias("k"))
    return sums.groupBy(group).agg(F.min(order).alias("b")).select(group, F.col("b.k").alias("medoid"))


def silhouettes(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """Silhouette of each row: (nearest other group - own) / larger; rows alone in their group get 0."""
    df = df.where(F.col(key).isNotNull())
    if df.select(key).distinct().limit(2).count() < 2:
        df = df.where(F.lit(False))  # no pair, no row
    parts = distance_parts(df, key, group, vector, across=True)
    means = parts.groupBy("key", "group", "other").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    wide = means.groupBy("key", "group").agg(
        F.min(F.when(F.col("other") == F.col("group"), F.col("d"))).alias("own"), F.min(F.when(F.col("other") != F.col("group"), F.col("d"))).alias("near"))
    value = (F.col("near") - F.col("own")) / F.nullif(F.greatest("near", "own"), F.lit(0.0))
    return wide.select(F.col("key").alias(key), F.col("group").alias(group), F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def labelled(df: DataFrame, key: str, vector: str, k: int, method: str) -> DataFrame:
    """Labels of one space by linkage or k-means, in one task: the space is a set of recordings, bounded by the caller."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        label = kernels.kmeans_labels(x, k) if method == "kmeans" else kernels.linkage_labels(x, k, method)
        return pd.DataFrame({key: pdf[key].to_numpy(), "label": label})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).groupBy(F.lit("space")).applyInPandas(run, f"{key} {kind}, label int")


def principal_components(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Scores on the leading components. The covariance is one aggregate; only it reaches the driver."""
    size = df.select(F.max(F.size(vector))).first()[0] or 0
    if not size:
        return df.select(key, F.lit(None).cast("array<double>").alias("scores"))
    get = lambda i: F.get(vector, F.lit(i))
    row = df.agg(
        F.count("*").alias("n"), F.array(*(F.sum(get(i)) for i in range(size))).alias("s"),
        F.array(*(F.sum(get(i) * get(j)) for i in range(size) for j in range(i, size))).alias("p")).first()
    mean = np.array(row["s"]) / row["n"]
    cov = np.zeros((size, size))
    cov[np.triu_indices(size)] = row["p"]
    cov = (cov + np.triu(cov, 1).T) / row["n"] - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :dims]
    top = top * np.where(np.take_along_axis(top, np.abs(top).argmax(0)[None], 0)[0] < 0, -1, 1)
    centered = F.zip_with(vector, A.constant(mean), lambda v, m: v - m)
    return df.select(key, F.array(*(A.dot(centered, A.constant(top[:, d])) for d in range(dims))).alias("scores"))


def scaled_layout(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Classical scaling of the vectors' distances, without the distances.

    The double-centred squares are the products of the centred vectors, whose leading eigenvectors times the roots of
    their values are the scores on the components of the much smaller scatter matrix. That matrix is summed in parts;
    signs make the largest entry of each dimension positive (to 9 digits, then the lowest key's). Null vectors have no place.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.when(~unmeasured(vector), F.col(vector)).alias("x"))
    get = lambda i: F.get("x", F.lit(i))
    size = rows.select(F.max(F.size("x"))).first()[0] or 0
    if size < 1:
        return rows.select(key, F.lit(None).cast("array<double>").alias("place"))
    n, *mean = rows.agg(F.count("x"), *(F.avg(get(i)) for i in range(size))).first()
    mean = np.array(mean, float)

    def scatter(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["s"])

    parts = rows.where("x is not null").select("x").mapInArrow(scatter, "s array<double>").select(F.posexplode("s").alias("at", "s"))
    total = np.zeros(size * size)
    for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():
        total[r["at"]] = r["s"]
    top = np.linalg.eigh(total.reshape(size, size))[1][:, ::-1][:, : min(dims, n)]
    top = np.pad(top, ((0, 0), (0, min(dims, n) - top.shape[1])))
    centered = F.zip_with("x", A.constant(mean), lambda v, m: v - m)
    placed = rows.select(key, F.when(F.col("x").isNotNull(), F.array(*(A.dot(centered, A.constant(v)) for v in top.T))).alias("place"))
    entry = lambda k: F.get("place", F.lit(k))
    first = [F.min(F.struct((-F.floor(F.abs(entry(k)) * 1e9 + 0.5)).alias("size"), F.col(key).alias("key"), (entry(k) < 0).alias("less"))) for k in range(top.shape[1])]
    turned = placed.where("place is not null").agg(*(f.getField("less").alias(f"d{k}") for k, f in enumerate(first))).first()
    sign = A.constant([-1.0 if less else 1.0 for less in turned])
    return placed.select(F.col(key).cast(kind).alias(key), F.zip_with("place", sign, lambda v, t: v * t).alias("place"))
