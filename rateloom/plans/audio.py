"""Queries of the sequential kernels over the driver tables: vectors and ordered events stand for signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateloom.functions import codec, kernels, loops, spectra
from rateloom.functions import arrays as A
from rateloom.functions import scalars as S
from rateloom.operators import notes
from rateloom.plans.relations import r6
from rateloom.plans.signals import MAG, lst, magnitudes_sql, sdot, vectors
from rateloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
ARRAY = T.ArrayType(T.DoubleType())
RATE = 8000


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def per_signal(kernel):
    """A pandas UDF from a signal to a list of numbers."""

    @F.pandas_udf(ARRAY)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in kernel(np.asarray(s, float))] for s in x])

    return run


def columns(df, kernel, names, digits=5):
    made = df.withColumn("out", per_signal(kernel)("x"))
    return made.select(*(c for c in df.columns if c != "x"), *(S.rounded(F.get("out", F.lit(k)), digits).alias(n) for k, n in enumerate(names)))


def series(spark, d):
    """The events of each type in order, as one signal."""
    ev = table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return ev.select("event_type", F.transform("s", lambda e: e["value"]).alias("x"))


@query()
def codec_operating_points(spark, d):
    ways = [codec.Encoding(RATE, 16), codec.Encoding(RATE, 8), codec.Encoding(RATE // 2, 8), codec.Encoding(RATE // 4, 8, compress=True)]
    v = vectors(spark, d).select("vec_id", "x")
    return columns(v, lambda x: [z for w in ways for z in codec.operating_point(x, RATE, w)], [f"{n}{k}" for k in range(4) for n in ("bytes", "loss")])


@query()
def loop_offers(spark, d):
    def run(x):
        x = x - x.mean()
        bounds, _ = loops.search(x, 1000, 2, 100)
        done = loops.settle(x, bounds)
        return [len(bounds), sum(q["rejected"] is None for q in done), min((q["end"] - q["start"] for q in done), default=0)]

    return columns(series(spark, d), run, ["candidates", "offered", "shortest"])


@query()
def carrier_decompose(spark, d):
    def run(x):
        level, carrier = kernels.decompose(x, np.hanning(9) + 1e-9)
        return [np.abs(level * carrier - x).max(), level.mean(), np.abs(carrier).max()]

    return columns(vectors(spark, d).select("vec_id", "x"), run, ["error", "level", "crest"])


@query()
def piecewise_levels(spark, d):
    def run(x):
        readings = 10 * np.log10((x[: len(x) // 50 * 50].reshape(-1, 50) ** 2).mean(axis=1) + 1e-12)
        knots, values = kernels.piecewise_fit(np.arange(len(readings), dtype=float), readings, 4)
        return [len(knots), values[0], values[-1]]

    return columns(series(spark, d), run, ["corners", "first_db", "last_db"], 4)


@query()
def shared_trajectory(spark, d):
    """One shape over the hours, an offset for each event type; the cells are counts and means, 24 a type."""
    cells = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["event_type", "hour"])
        code, names = pd.factorize(pdf["event_type"], sort=True)
        _, offset = kernels.shared_trajectory(pdf["hour"].to_numpy(), code, pdf["v"].to_numpy(float), pdf["n"].to_numpy(float))
        return pd.DataFrame({"event_type": names, "offset": np.floor(offset * 1e4 + 0.5) / 1e4})

    return cells.groupBy(F.lit("all")).applyInPandas(run, "event_type string, offset double")


@query()
def mfcc_vectors(spark, d):
    return columns(vectors(spark, d).select("vec_id", "x"), lambda x: spectra.mfcc(x, RATE, 32, 16, 8, 4).mean(axis=0), ["c0", "c1", "c2", "c3"], 4)


@query()
def resample_vectors(spark, d):
    return columns(vectors(spark, d).select("vec_id", "x"), lambda x: [codec.snr(x, kernels.resample(kernels.resample(x, 48), 64)), np.abs(kernels.resample(x, 96)).max()], ["snr", "peak"], 4)


HALF = [1.0 if k % 2 == 0 else -1.0 for k in range(64)]


@query(f"SELECT vec_id, {r6('abs(list_sum(list_transform(list_zip(list_transform(embedding, lambda e: e::DOUBLE), ' + lst(HALF) + '), lambda p: p[1] * p[2])))', 5)} AS nyquist FROM embeddings")
def nyquist_energy(spark, d):
    return vectors(spark, d).select("vec_id", S.rounded(F.abs(A.dot(F.col("x"), A.constant(HALF))), 5).alias("nyquist"))


def band_power_sql() -> str:
    """Energies of the three bands of 64 samples from their magnitudes: every inner bin stands for two."""
    shares = np.where(np.isin(np.arange(33), (0, 32)), 1, 2) / 64
    bands = (spectra.band_masks(64, RATE, [500, 2000]) ** 2 * shares).tolist()
    return ", ".join(r6(sdot("list_transform(m, lambda e: e * e)", lst(row)), 5) + f" AS {name}" for name, row in zip(("low", "mid", "high"), bands))


@query(f"WITH {MAG} SELECT vec_id, 0.0::DOUBLE AS error, {band_power_sql()} FROM m")
def split_bands(spark, d):
    def run(x):
        bands = spectra.split_bands(x, RATE, [500, 2000])
        return [np.abs(bands.sum(axis=0) - x).max(), *(bands**2).sum(axis=1)]

    return columns(vectors(spark, d).select("vec_id", "x"), run, ["error", "low", "mid", "high"])


EIGHTHS = "[" + ", ".join(f"list_avg(m[{a + 1}:{b}])" for a, b in zip([0, *range(5, 33, 4)], range(5, 34, 4))) + "]"


@query(f"""WITH v AS (SELECT vec_id, list_transform(list_zip(list_transform(embedding, lambda e: e::DOUBLE), {lst(np.hanning(64))}), lambda p: p[1] * p[2]) AS x FROM embeddings),
s AS (SELECT vec_id, {magnitudes_sql(64)} AS a FROM v), m AS (SELECT vec_id, list_transform(a, lambda e: e * e) AS m FROM s), e AS (SELECT vec_id, {EIGHTHS} AS e FROM m),
k AS (SELECT vec_id, list_max(list_filter(range(1, 9), lambda k: e[k] >= list_max(e) * 0.01::DOUBLE)) * 1000 AS need FROM e)
SELECT vec_id, CASE WHEN need <= 1000 THEN 1000.0 WHEN need <= 2000 THEN 2000.0 WHEN need <= 4000 THEN 4000.0 ELSE 8000.0 END::DOUBLE AS rate FROM k""")
def settled_rates(spark, d):
    ladder = [1000, 2000, 4000, 8000]
    return columns(vectors(spark, d).select("vec_id", "x"), lambda x: [codec.lowest_rung(ladder, 2 * codec.content_edge(x, RATE, 20.0, 8))], ["rate"])


@query()
def spectral_metrics(spark, d):
    """Cepstral and multi-resolution distance of each vector to its own 8-bit version."""
    def run(x):
        y = codec.requantize(x, 4)
        return [spectra.multi_resolution_distance(x, y), spectra.cepstral_distortion(x, y, RATE, 32, 16, 8, 4)]

    return columns(vectors(spark, d).select("vec_id", "x"), run, ["stft", "cepstral"], 4)


@query()
def layer_search(spark, d):
    part = table(spark, d, "part")
    cell = F.least(F.floor((F.col("p_size") - 1) / 10), F.lit(4)).cast("int")
    points = part.groupBy("p_brand", cell.alias("cell"), F.col("p_size").cast("long").alias("bytes")).agg(F.min("p_retailprice").alias("loss"))
    cells = points.groupBy("p_brand", "cell").agg(F.array_sort(F.collect_list(F.struct("bytes", "loss"))).alias("points"))
    found = notes.layered(cells, "p_brand", 120, 3, 0.05)
    return found.select("p_brand", "layers", S.rounded(F.col("loss"), 4).alias("loss"), "bytes")


@query("""SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS longest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def material_by_key(spark, d):
    held = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return held.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("longest"))


@query("SELECT o_custkey, count(*) AS lost FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY 1")
def screen_losses(spark, d):
    orders = table(spark, d, "orders")
    keys = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return notes.screened(orders, keys, "o_custkey")[1]


@query("""SELECT n_regionkey, '{"n_regionkey":' || n_regionkey || ',"n":' || count(*) || ',"rows":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS document FROM nation GROUP BY 1""")
def plan_documents(spark, d):
    return notes.document(table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"])


@query("""WITH a AS (SELECT event_type, hour(ts) * 5 AS v, 10 * log10(avg(value * value)) AS db FROM events GROUP BY 1, 2 HAVING avg(value * value) > 0),
g AS (SELECT event_type, unnest(range(0, 128)) AS velocity FROM (SELECT DISTINCT event_type FROM events)),
l AS (SELECT g.*, a.v AS v0, a.db AS y0 FROM g ASOF LEFT JOIN a ON a.event_type = g.event_type AND a.v <= g.velocity),
h AS (SELECT l.*, a.v AS v1, a.db AS y1 FROM l ASOF LEFT JOIN a ON a.event_type = l.event_type AND a.v >= l.velocity),
d AS (SELECT event_type, velocity, CASE WHEN v0 IS NULL THEN y1 WHEN v1 IS NULL OR v1 = v0 THEN y0 ELSE y0 + (y1 - y0) / (v1 - v0) * (velocity - v0) END AS db FROM h),
t AS (SELECT event_type, db AS top FROM d WHERE velocity = 100)
SELECT event_type, CAST(velocity AS INT) AS velocity, CAST(coalesce(greatest(least(round_even(64 * power(10.0::DOUBLE, (greatest(db, top - 48) - top) / 20), 0), 64), 0), 0) AS INT) AS volume FROM d JOIN t USING (event_type)""")
def velocity_volumes(spark, d):
    levels = table(spark, d, "events").groupBy("event_type", (F.hour("ts") * 5).alias("v")).agg((10 * F.log10(F.avg(F.col("value") * F.col("value")))).alias("db"))
    listed = levels.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("v", "db"))).alias("p"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def volumes(p: pd.Series) -> pd.Series:
        return pd.Series([notes.velocity_volumes({int(a["v"]): float(a["db"]) for a in points}, 100) for points in p])

    return listed.select("event_type", F.posexplode(volumes("p")).alias("velocity", "volume"))
