"""Queries of the diagnostics over neighbouring vectors, each with its DuckDB counterpart."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rateloom.functions import arrays as A
from rateloom.functions import diagnostics as D
from rateloom.functions import scalars as S
from rateloom.operators import material, notes
from rateloom.plans.relations import r6
from rateloom.plans.signals import DIM, MAG, PAIR, lst, magnitudes_sql, pairs, sdot, vectors
from rateloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
RATE = 8000.0
LENGTH, HOP, FRAMES, BANDS, DOWN_DB = 16, 8, 7, 3, 40.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def masked(magnitude: str, low: float, high: float) -> str:
    """Sum of squared magnitudes in a band, as SQL."""
    held = lst(low <= k * RATE / DIM < high for k in range(DIM // 2 + 1))
    return f"list_sum(list_transform(list_zip({magnitude}, {held}), lambda p: p[1] * p[1] * p[2]))"


def power(magnitude: str, low: float, high: float) -> str:
    """The same with each bin's share of the samples' energy."""
    held = lst((1 if k in (0, DIM // 2) else 2) / DIM * (low <= k * RATE / DIM < high) for k in range(DIM // 2 + 1))
    return f"list_sum(list_transform(list_zip({magnitude}, {held}), lambda p: p[1] * p[1] * p[2]))"


EDGES = [0.0, 500.0, 2000.0, 4000.0]


@query(f"WITH {MAG} SELECT vec_id, {', '.join(r6(masked('m', a, b), 4) + f' AS band{k}' for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))} FROM m")
def band_energies(spark, d):
    m = vectors(spark, d).select("vec_id", A.dft_magnitude(F.col("x"), DIM).alias("m"))
    return m.select("vec_id", *(S.rounded(D.band_energy(F.col("m"), DIM, RATE, a, b), 4).alias(f"band{k}") for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]))))


NEXT = f"{MAG}, n AS (SELECT a.vec_id, a.m AS a, b.m AS b FROM m a JOIN m b ON b.vec_id = a.vec_id + 1)"


@query(f"WITH {NEXT} SELECT vec_id, {r6(f'10 * log10(({masked("a", 1500.0, 4000.0)} + 1e-12) / ({masked("b", 1500.0, 4000.0)} + 1e-12))', 4)} AS loss_db FROM n")
def hf_loss_pairs(spark, d):
    both = pairs(spark, d).select("vec_id", *(A.dft_magnitude(F.col(c), DIM).alias(c) for c in "xy"))
    return both.select("vec_id", S.rounded(D.hf_loss_db(F.col("x"), F.col("y"), DIM, RATE, 1500.0), 4).alias("loss_db"))


ERROR = f"{PAIR}, e AS (SELECT vec_id, x AS s, list_transform(list_zip(x, y), lambda p: p[1] - p[2]) AS x FROM p), q AS (SELECT vec_id, s, {magnitudes_sql(DIM)} AS e FROM e), w AS (SELECT vec_id, e, s AS x FROM q), g AS (SELECT vec_id, e, {magnitudes_sql(DIM)} AS s FROM w)"


@query(f"WITH {ERROR} SELECT vec_id, {r6(f'10 * log10(({power("s", 500.0, 2000.0)} + 1e-12) / {power("e", 500.0, 2000.0)})', 4)} AS snr FROM g")
def band_snr_pairs(spark, d):
    both = pairs(spark, d).select("vec_id", A.dft_magnitude(F.col("x"), DIM).alias("x"), A.dft_magnitude(A.noise(F.col("x"), F.col("y")), DIM).alias("e"))
    return both.select("vec_id", S.rounded(D.band_snr(F.col("x"), F.col("e"), DIM, RATE, 500.0, 2000.0), 4).alias("snr"))


def frame_sql(source: str) -> str:
    """Hann-windowed magnitudes of a frame f, as SQL."""
    taper, bins = A.hann(LENGTH), []
    for k in range(LENGTH // 2 + 1):
        parts = [sdot(source, lst(taper[t] * wave(2 * math.pi * k * t / LENGTH) for t in range(LENGTH))) for wave in (math.cos, math.sin)]
        bins.append("sqrt(" + " + ".join(f"{p} * {p}" for p in parts) + ")")
    return "[" + ", ".join(bins) + "]"


FRAMED = f"""v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
f AS (SELECT vec_id, i, x[i * {HOP} + 1:i * {HOP} + {LENGTH}] AS f FROM (SELECT *, unnest(range(0, {FRAMES})) AS i FROM v)),
s AS (SELECT vec_id, i, {frame_sql('f')} AS s FROM f)"""


@query(f"""WITH {FRAMED}, c AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.s, b.s), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS c
  FROM s a JOIN s b ON b.vec_id = a.vec_id AND b.i = a.i + 1)
SELECT vec_id, {r6('stddev_pop(c)', 4)} AS deviation FROM c GROUP BY 1""")
def flux_deviation(spark, d):
    s = vectors(spark, d).select("vec_id", D.frame_magnitudes(F.col("x"), LENGTH, HOP).alias("s"))
    return s.select("vec_id", S.rounded(D.spread(D.flux_series(F.col("s"))), 4).alias("deviation"))


BANK = A.mel_bank(LENGTH // 2 + 1, RATE, BANDS)
MELS = ", ".join(sdot("list_transform(s, lambda e: e * e)", lst(row)) for row in BANK)


@query(f"""WITH {FRAMED}, e AS (SELECT vec_id, i, [{MELS}] AS e FROM s), b AS (SELECT vec_id, i, k, e[k] AS e FROM (SELECT *, unnest(range(1, {BANDS + 1})) AS k FROM e)),
t AS (SELECT vec_id, greatest(max(e) * {10 ** (-DOWN_DB / 10)!r}::DOUBLE, 1e-12::DOUBLE) AS low FROM b GROUP BY 1)
SELECT p.vec_id, {r6('avg(abs(ln(greatest(p.e, t.low)) - ln(greatest(q.e, t.low))))', 4)} AS distance
FROM b p JOIN b q ON q.vec_id = p.vec_id + 1 AND q.i = p.i AND q.k = p.k JOIN t ON t.vec_id = p.vec_id GROUP BY 1""")
def log_mel_pairs(spark, d):
    both = pairs(spark, d).select("vec_id", *(D.frame_magnitudes(F.col(c), LENGTH, HOP).alias(c) for c in "xy"))
    return both.select("vec_id", S.rounded(D.log_mel_distance(F.col("x"), F.col("y"), LENGTH, RATE, BANDS, DOWN_DB), 4).alias("distance"))


WEIGHTS = {"centroid": 0.4, "rolloff": 0.2, "flatness": 0.3, "flux": 0.1}
BINS = LENGTH // 2 + 1


@query(f"""WITH {FRAMED}, r AS (SELECT vec_id, {sdot('s', lst(k * RATE / LENGTH for k in range(BINS)))} / list_sum(s) AS centroid,
  list_min(list_filter(range(0, {BINS}), lambda k: list_sum(s[1:k + 1]) >= 0.85::DOUBLE * list_sum(s) - 1e-9::DOUBLE)) * {RATE / LENGTH}::DOUBLE AS rolloff,
  exp(list_avg(list_transform(s, lambda e: ln(e * e + 1e-12::DOUBLE)))) / list_avg(list_transform(s, lambda e: e * e + 1e-12::DOUBLE)) AS flatness FROM s),
c AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.s, b.s), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS c FROM s a JOIN s b ON b.vec_id = a.vec_id AND b.i = a.i + 1),
m AS (SELECT * FROM (SELECT vec_id, avg(centroid) AS centroid, avg(rolloff) AS rolloff, avg(flatness) AS flatness FROM r GROUP BY 1) JOIN (SELECT vec_id, stddev_pop(c) AS flux FROM c GROUP BY 1) USING (vec_id))
SELECT a.vec_id, {r6(' + '.join(f"{w}::DOUBLE * abs(a.{k} - b.{k})" + ("" if k == "flatness" else f" / (abs(a.{k}) + 1e-12::DOUBLE)") for k, w in WEIGHTS.items()), 4)} AS distance
FROM m a JOIN m b ON b.vec_id = a.vec_id + 1""")
def spectral_shape_pairs(spark, d):
    both = pairs(spark, d).select("vec_id", *(D.frame_magnitudes(F.col(c), LENGTH, HOP).alias(c) for c in "xy"))
    return both.select("vec_id", S.rounded(D.spectral_shape(F.col("x"), F.col("y"), LENGTH, RATE, 0.85, WEIGHTS), 4).alias("distance"))


@query("""SELECT p_partkey, p_retailprice / 1024.0::DOUBLE AS kib, CAST(round_even(p_size * 1000 * 22050::DOUBLE / 44100, 0) AS BIGINT) AS frames,
  floor(power(10.0::DOUBLE, (-p_size / 20.0::DOUBLE)) * 1000000 + 0.5) / 1000000 AS peak FROM part""")
def stored_sizes(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", S.bytes_to_kib(F.col("p_retailprice")).alias("kib"), S.resampled_frames(F.col("p_size") * 1000, 44100, 22050).alias("frames"),
                       S.rounded(S.headroom_peak(F.col("p_size"))).alias("peak"))


@query("""WITH k AS (SELECT l_suppkey, l_partkey % 128 AS key FROM lineitem), per AS (SELECT l_suppkey, count(DISTINCT key) AS n FROM k WHERE key BETWEEN 21 AND 108 GROUP BY 1)
SELECT CAST(88 AS BIGINT) AS numbered, (SELECT count(DISTINCT key) FROM k WHERE key BETWEEN 21 AND 108) AS played, (SELECT min(coalesce(n, 0)) FROM (SELECT DISTINCT l_suppkey FROM k) LEFT JOIN per USING (l_suppkey)) AS answered""")
def keyboard_coverage(spark, d):
    routed = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 128).alias("key"))
    return material.key_coverage(routed, "l_suppkey", "key", 21, 108)


@query("""WITH r AS (SELECT l_partkey, max(l_quantity) AS needed, arg_max(l_quantity, [CAST(l_orderkey AS BIGINT), l_linenumber]) AS kept FROM lineitem GROUP BY 1)
SELECT l_partkey, kept, needed FROM r WHERE kept < needed""")
def kept_shortfalls(spark, d):
    lines = table(spark, d, "lineitem")
    kept = lines.groupBy("l_partkey").agg(F.max("l_quantity").alias("needed"), F.max_by("l_quantity", F.struct("l_orderkey", "l_linenumber")).alias("kept"))
    return notes.shortfalls(kept, "kept", "needed").select("l_partkey", "kept", "needed")
