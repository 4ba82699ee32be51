"""Queries over ordered events, vectors and verdicts, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rateloom.functions import arrays as A
from rateloom.functions import scalars as S
from rateloom.operators import agreement, cluster, linkage, listening
from rateloom.plans.relations import r6
from rateloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ordered events


@query(f"""WITH r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS win FROM events)
SELECT event_type, win, {r6('10 * log10(avg(value * value))', 5)} AS rms_db FROM r GROUP BY ALL HAVING count(*) = 50""")
def level_readings_rms(spark, d):
    place = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    wins = table(spark, d, "events").select("event_type", "value", F.floor(place / 50).alias("win"))
    out = wins.groupBy("event_type", "win").agg(F.avg(F.col("value") * F.col("value")).alias("p"), F.count("*").alias("n")).where("n = 50")
    return out.select("event_type", "win", S.rounded(10 * F.log10("p"), 5).alias("rms_db"))


@query(f"""WITH r AS (SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) / 1000 AS x, value AS y FROM events),
m AS (SELECT event_type, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r GROUP BY 1)
SELECT event_type, {r6('(n * sxy - sx * sy) / (n * sxx - sx * sx)', 4)} AS slope, {r6('(sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n', 4)} AS intercept FROM m""")
def decay_trend_regr(spark, d):
    place = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("double") / 1000
    r = table(spark, d, "events").select("event_type", place.alias("x"), F.col("value").alias("y"))
    m = r.groupBy("event_type").agg(F.count("*").alias("n"), *(F.sum(e).alias(a) for e, a in ((F.col("x"), "sx"), (F.col("y"), "sy"), (F.col("x") * F.col("x"), "sxx"), (F.col("x") * F.col("y"), "sxy"))))
    slope = F.expr("(n * sxy - sx * sy) / (n * sxx - sx * sx)")
    return m.select("event_type", S.rounded(slope, 4).alias("slope"), S.rounded((F.col("sy") - slope * F.col("sx")) / F.col("n"), 4).alias("intercept"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, CAST(coalesce(max(CASE WHEN value > 60 THEN i END), 0) AS BIGINT) AS frames, count(*) AS n FROM r GROUP BY 1""")
def trim_content_frames(spark, d):
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    r = table(spark, d, "events").select("user_id", "value", place.alias("i"))
    return r.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("value") > 60, F.col("i"))), F.lit(0)).cast("long").alias("frames"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, value > 10 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
w AS (SELECT user_id, i, count(*) FILTER (WHERE ok) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS held FROM r)
SELECT user_id, min(CASE WHEN held = 4 THEN i END) AS first_start FROM w GROUP BY 1""")
def held_run_first(spark, d):
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    r = table(spark, d, "events").select("user_id", (F.col("value") > 10).alias("ok"), place.cast("long").alias("i"))
    held = F.count_if("ok").over(W.partitionBy("user_id").orderBy("i").rowsBetween(0, 3))
    return r.withColumn("held", held).groupBy("user_id").agg(F.min(F.when(F.col("held") == 4, F.col("i"))).alias("first_start"))


@query("""SELECT event_id, user_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS low,
  max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events""")
def running_min_limit(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, d, "events")
    return ev.select("event_id", "user_id", F.min("value").over(w.rowsBetween(-5, 2)).alias("low"), F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("top"), F.row_number().over(w).cast("long").alias("place"))


@query(f"""SELECT event_id, {r6('avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)', 5)} AS pooled,
  {r6('value - lag(value, 1, value) OVER (PARTITION BY event_type ORDER BY ts, event_id)', 5)} AS change FROM events""")
def window_mean_travel(spark, d):
    w = W.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", S.rounded(F.avg("value").over(w.rowsBetween(-3, 3)), 5).alias("pooled"), S.rounded(F.col("value") - F.lag("value", 1).over(w), 5).alias("c"), F.lit(0.0).alias("z")).select("event_id", "pooled", F.coalesce("c", "z").alias("change"))


@query(f"""WITH a AS (SELECT CAST(extract(hour FROM ts) AS INT) * 5 AS x, avg(value) AS y FROM events GROUP BY 1),
g AS (SELECT unnest(range(0, 128)) AS v),
b AS (SELECT v, max(x) FILTER (WHERE x <= v) AS lo, min(x) FILTER (WHERE x >= v) AS hi FROM g, a GROUP BY 1)
SELECT CAST(v AS INT) AS velocity, {r6('CASE WHEN lo IS NULL THEN h.y WHEN hi IS NULL THEN l.y ELSE l.y + (h.y - l.y) * coalesce((v - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 0) END', 4)} AS level
FROM b LEFT JOIN a l ON l.x = lo LEFT JOIN a h ON h.x = hi""")
def velocity_map_interp(spark, d):
    hour = F.hour("ts")
    anchors = table(spark, d, "events").groupBy((hour * 5).cast("double").alias("x")).agg(F.avg("value").alias("y"))
    points = anchors.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))  # 24 hours at most
    grid = spark.range(128).crossJoin(F.broadcast(points))
    return grid.select(F.col("id").cast("int").alias("velocity"), S.rounded(A.interpolate(F.col("id").cast("double"), F.col("p")), 4).alias("level"))


# vectors


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("x"))


def lst(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def sdot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"


def magnitudes_sql(n: int) -> str:
    parts = []
    for k in range(n // 2 + 1):
        re = sdot("x", lst(math.cos(2 * math.pi * k * t / n) for t in range(n)))
        im = sdot("x", lst(math.sin(2 * math.pi * k * t / n) for t in range(n)))
        parts.append(f"sqrt({re} * {re} + {im} * {im})")
    return "[" + ", ".join(parts) + "]"


N = DIM
MAG = f"{V}, m AS (SELECT vec_id, {magnitudes_sql(N)} AS m FROM v)"
FREQS = [k / N for k in range(N // 2 + 1)]


def spectra(spark, d):
    return vectors(spark, d).select("vec_id", A.dft_magnitude(F.col("x"), N).alias("m"))


@query(f"WITH {V} SELECT vec_id, {r6('list_sum(list_transform(range(1, 61), lambda i: (x[i] - list_avg(x)) * (x[i + 4] - list_avg(x)))) / list_sum(list_transform(x, lambda e: (e - list_avg(x)) * (e - list_avg(x))))', 5)} AS lag4 FROM v")
def autocorrelation_lags(spark, d):
    return vectors(spark, d).select("vec_id", S.rounded(F.get(A.autocorrelation(F.col("x"), 4), F.lit(4)), 5).alias("lag4"))


@query(f"WITH {V} SELECT vec_id, CAST(i // 8 AS INT) AS frame, {r6('list_sum(x[i + 1:i + 16])', 5)} AS total FROM (SELECT *, unnest(range(0, 49, 8)) AS i FROM v)")
def frame_hop(spark, d):
    out = vectors(spark, d).select("vec_id", F.posexplode(A.frames(F.col("x"), 16, 8)).alias("frame", "f"))
    return out.select("vec_id", "frame", S.rounded(A.total(F.col("f")), 5).alias("total"))


@query(f"WITH {MAG} SELECT vec_id, CAST(k - 1 AS INT) AS bin, {r6('m[k]', 5)} AS magnitude FROM (SELECT *, unnest(range(1, {N // 2 + 2})) AS k FROM m)")
def dft_magnitude(spark, d):
    return spectra(spark, d).select("vec_id", F.posexplode("m").alias("bin", "v")).select("vec_id", "bin", S.rounded(F.col("v"), 5).alias("magnitude"))


@query(f"WITH {MAG} SELECT vec_id, {r6(sdot('m', lst(FREQS)) + ' / list_sum(m)', 5)} AS centroid FROM m")
def spectral_centroid(spark, d):
    return spectra(spark, d).select("vec_id", S.rounded(A.centroid(F.col("m"), FREQS), 5).alias("centroid"))


@query(f"WITH {MAG} SELECT vec_id, CAST(list_min(list_filter(range(0, {N // 2 + 1}), lambda k: list_sum(m[1:k + 1]) >= 0.85 * list_sum(m) - 1e-9)) AS INT) AS bin FROM m")
def spectral_rolloff(spark, d):
    return spectra(spark, d).select("vec_id", A.rolloff_bin(F.col("m"), 0.85).alias("bin"))


@query(f"WITH {MAG} SELECT vec_id, {r6('exp(list_avg(list_transform(m, lambda e: ln(e * e + 1e-12)))) / list_avg(list_transform(m, lambda e: e * e + 1e-12))', 5)} AS flatness FROM m")
def spectral_flatness(spark, d):
    return spectra(spark, d).select("vec_id", S.rounded(A.flatness(F.transform("m", lambda e: e * e)), 5).alias("flatness"))


@query(f"WITH {V} SELECT a.vec_id, {r6('sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))', 5)} AS flux FROM v a JOIN v b ON b.vec_id = a.vec_id - 1")
def spectral_flux(spark, d):
    v = vectors(spark, d)
    prior = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("x").alias("y"))
    return v.join(prior, "vec_id").select("vec_id", S.rounded(A.flux(F.col("y"), F.col("x")), 5).alias("flux"))


MEL = A.mel_bank(N // 2 + 1, 16000.0, 4)


@query(f"WITH {MAG}, p AS (SELECT vec_id, list_transform(m, lambda e: e * e) AS p FROM m) SELECT vec_id, {', '.join(r6(sdot('p', lst(row)), 5) + f' AS band{k}' for k, row in enumerate(MEL))} FROM p")
def mel_energies(spark, d):
    bands = spectra(spark, d).select("vec_id", A.mel_energies(F.col("m"), N // 2 + 1, 16000.0, 4).alias("e"))
    return bands.select("vec_id", *(S.rounded(F.get("e", F.lit(k)), 5).alias(f"band{k}") for k in range(4)))


@query(f"WITH {V} SELECT vec_id, {', '.join(r6(sdot('x', lst(math.sqrt((1 if k == 0 else 2) / DIM) * math.cos(math.pi * (t + 0.5) * k / DIM) for t in range(DIM))), 5) + f' AS c{k}' for k in range(3))} FROM v")
def dct2(spark, d):
    c = vectors(spark, d).select("vec_id", A.dct2(F.col("x"), DIM, 3).alias("c"))
    return c.select("vec_id", *(S.rounded(F.get("c", F.lit(k)), 5).alias(f"c{k}") for k in range(3)))


PAIR = f"{V}, p AS (SELECT a.vec_id, a.x AS x, b.x AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"
NOISE = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
SQX = "list_sum(list_transform(x, lambda e: e * e))"


def pairs(spark, d):
    v = vectors(spark, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"WITH {PAIR} SELECT vec_id, {r6(f'10 * log10(({SQX} + 1e-12) / ({NOISE} + 1e-12))', 5)} AS snr FROM p")
def snr_pairs(spark, d):
    return pairs(spark, d).select("vec_id", S.rounded(A.snr(F.col("x"), F.col("y")), 5).alias("snr"))


@query(f"WITH {PAIR}, g AS (SELECT vec_id, x, y, {sdot('x', 'y')} / {SQX} AS g FROM p) SELECT vec_id, {r6('10 * log10((list_sum(list_transform(x, lambda e: (e * g) * (e * g))) + 1e-12) / (list_sum(list_transform(list_zip(x, y), lambda p: (p[1] * g - p[2]) * (p[1] * g - p[2]))) + 1e-12))', 4)} AS si_sdr FROM g")
def si_sdr_pairs(spark, d):
    return pairs(spark, d).select("vec_id", S.rounded(A.si_sdr(F.col("x"), F.col("y")), 4).alias("si_sdr"))


@query(f"""WITH {PAIR}, f AS (SELECT vec_id, list_transform(range(0, 4), lambda i: 10 * log10((list_sum(list_transform(x[i * 16 + 1:i * 16 + 16], lambda e: e * e)) + 1e-12)
  / (list_sum(list_transform(list_zip(x[i * 16 + 1:i * 16 + 16], y[i * 16 + 1:i * 16 + 16]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) + 1e-12))) AS r FROM p)
SELECT vec_id, {r6('list_avg(list_transform(r, lambda e: greatest(least(e, 35.0::DOUBLE), -10.0::DOUBLE)))', 5)} AS seg FROM f""")
def segmental_snr(spark, d):
    return pairs(spark, d).select("vec_id", S.rounded(A.segmental_snr(F.col("x"), F.col("y"), 16, -10.0, 35.0), 5).alias("seg"))


@query(f"WITH {PAIR} SELECT vec_id, {r6(f'0.5 * sqrt({NOISE}) + 0.5 * abs(list_max(x) - list_max(y))', 5)} AS score FROM p")
def composite_score(spark, d):
    from rateloom.functions.metrics import build_composite

    score = build_composite({"spectral_distance": 0.5, "peak_delta": 0.5})
    return pairs(spark, d).select("vec_id", S.rounded(score(F.col("x"), F.col("y")), 5).alias("score"))


@query(f"WITH {V}, q AS (SELECT vec_id, list_transform(x, lambda e: least(greatest(round_even(e * 128, 0), -128), 127) / 128) AS q, x FROM v) SELECT vec_id, CAST(list_sum(list_transform(q, lambda e: e * 128)) AS BIGINT) AS steps, CAST(list_max(q) * 128 AS BIGINT) AS top FROM q")
def quantize_grid(spark, d):
    q = vectors(spark, d).select("vec_id", A.quantize(F.col("x"), 8).alias("q"))
    return q.select("vec_id", (A.total(F.col("q")) * 128).cast("long").alias("steps"), (F.array_max("q") * 128).cast("long").alias("top"))


@query(f"WITH {V} SELECT vec_id, {r6('list_sum(x) * (0.9 / list_max(list_transform(x, lambda e: abs(e))))', 5)} AS total FROM v")
def peak_normalize(spark, d):
    return vectors(spark, d).select("vec_id", S.rounded(A.total(A.normalize_peak(F.col("x"), 0.9)), 5).alias("total"))


@query(f"WITH {V} SELECT vec_id, {r6('list_sum(list_transform(range(1, 65), lambda i: x[i] * least(1.0::DOUBLE, (64 - i) / 8.0::DOUBLE)))', 5)} AS total FROM v")
def release_fade(spark, d):
    return vectors(spark, d).select("vec_id", S.rounded(A.total(A.release_fade(F.col("x"), 8)), 5).alias("total"))


@query()
def noise_shape(spark, d):
    s = vectors(spark, d).select("vec_id", "x", A.noise_shaped(F.col("x"), 8).alias("q"))
    return s.select("vec_id", S.rounded(A.total(F.col("q")), 5).alias("total"), S.rounded(A.total(A.noise(F.col("x"), F.col("q"))), 6).alias("left_over"))


# groups of vectors

DIST = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@query(f"""WITH {V}, s AS (SELECT i, avg(x[i]) AS m, stddev_pop(x[i]) AS s FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1)
SELECT vec_id, {r6('sum(CASE WHEN s > 1e-12 THEN (x[i] - m) / s ELSE 0 END)', 4)} AS total FROM v, s GROUP BY 1""")
def zscore_population(spark, d):
    return cluster.standardized(vectors(spark, d), "x", DIM).select("vec_id", S.rounded(A.total(F.col("x")), 4).alias("total"))


@query(f"WITH {V} SELECT {r6('sum(v2) * 2 * max(n) / (max(n) - 1)', 5)} AS mean_square FROM (SELECT i, var_pop(x[i]) AS v2, count(*) AS n FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1)")
def unit_spread_scale(spark, d):
    return cluster.mean_pairwise_square(vectors(spark, d), "x", DIM).select(S.rounded(F.col("mean_square"), 5).alias("mean_square"))


@query(f"WITH {V} SELECT a.vec_id, a.label, {r6('sum(' + DIST + ')', 4)} AS total FROM v a JOIN v b USING (label) GROUP BY ALL")
def pairwise_distance(spark, d):
    return cluster.distance_sums(vectors(spark, d), "vec_id", "label", "x").select("vec_id", "label", S.rounded(F.col("total"), 4).alias("total"))


@query(f"WITH {V}, t AS (SELECT a.vec_id, a.label, sum({DIST}) AS total FROM v a JOIN v b USING (label) GROUP BY ALL) SELECT label, vec_id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY floor(total * 1e9 + 0.5), vec_id) AS rn FROM t) WHERE rn = 1")
def medoid(spark, d):
    return cluster.medoids(vectors(spark, d), "vec_id", "label", "x")


@query(f"WITH {V}, t AS (SELECT a.vec_id, a.label, sum({DIST} * (b.vec_id % 5 + 1)) AS total FROM v a JOIN v b USING (label) GROUP BY ALL) SELECT label, vec_id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY floor(total * 1e9 + 0.5), vec_id) AS rn FROM t) WHERE rn = 1")
def weighted_medoid(spark, d):
    return cluster.medoids(vectors(spark, d).withColumn("w", F.col("vec_id") % 5 + 1), "vec_id", "label", "x", "w")


CENTER = "c AS (SELECT label, list(m ORDER BY i) AS x FROM (SELECT label, i, avg(x[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {V}, {CENTER} SELECT vec_id, nearest FROM (SELECT a.vec_id, b.label AS nearest, row_number() OVER (PARTITION BY a.vec_id ORDER BY floor({DIST} * 1e9 + 0.5), b.label) AS rn FROM v a, c b) WHERE rn = 1")
def nearest_centroid(spark, d):
    v = vectors(spark, d)
    centers = cluster.group_means(v, "label", "x", DIM).select(F.col("label").alias("nearest"), "center")
    near = F.min(F.struct(F.floor(A.distance(F.col("x"), F.col("center")) * 1e9 + 0.5).alias("t"), "nearest"))
    return v.crossJoin(F.broadcast(centers)).groupBy("vec_id").agg(near.alias("b")).select("vec_id", "b.nearest")  # a center a group


@query(f"""WITH {V}, m AS (SELECT a.vec_id, a.label, b.label AS other, avg({DIST}) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL),
w AS (SELECT vec_id, label, min(d) FILTER (WHERE other = label) AS own, min(d) FILTER (WHERE other <> label) AS near FROM m GROUP BY ALL)
SELECT vec_id, label, {r6('coalesce((near - own) / greatest(near, own), 0)', 5)} AS silhouette FROM w""")
def silhouette(spark, d):
    return cluster.silhouettes(vectors(spark, d), "vec_id", "label", "x").select("vec_id", "label", S.rounded(F.col("silhouette"), 5).alias("silhouette"))


@query(f"""WITH {V}, {CENTER}, t AS (SELECT a.vec_id, a.label, {DIST} AS d FROM v a JOIN c b USING (label))
SELECT label, vec_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id % 3 <> 0, floor(d * 1e9 + 0.5), vec_id) AS rn FROM t) WHERE rn = 1""")
def representative_floor(spark, d):
    """Nearest to the center among members that meet a floor, else nearest of all."""
    v = vectors(spark, d)
    near = v.join(F.broadcast(cluster.group_means(v, "label", "x", DIM)), "label")
    order = F.struct((F.col("vec_id") % 3 != 0).alias("f"), F.floor(A.distance(F.col("x"), F.col("center")) * 1e9 + 0.5).alias("t"), F.col("vec_id").alias("k"))
    return near.groupBy("label").agg(F.min(order).alias("b")).select("label", F.col("b.k").alias("representative"))


@query()
def linkage_cut(spark, d):
    return linkage.average_labels(vectors(spark, d), "vec_id", "x", 10)


@query()
def kmeans(spark, d):
    return cluster.labelled(vectors(spark, d), "vec_id", "x", 10, "kmeans")


@query()
def pca(spark, d):
    return cluster.principal_components(vectors(spark, d), "vec_id", "x", 2).select("vec_id", S.rounded(F.get("scores", F.lit(0)), 5).alias("x"), S.rounded(F.get("scores", F.lit(1)), 5).alias("y"))


@query()
def mds(spark, d):
    return cluster.scaled_layout(vectors(spark, d), "vec_id", "x", 2).select("vec_id", S.rounded(F.get("place", F.lit(0)), 4).alias("x"), S.rounded(F.get("place", F.lit(1)), 4).alias("y"))


# verdicts

VERDICT = "j AS (SELECT l.doc_id, quality, toxic, n_chars, lang, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def verdicts(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


@query(f"""WITH {VERDICT}, p AS (SELECT sum(CASE WHEN sign(a.quality - b.quality) * sign(a.n_chars - b.n_chars) > 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN sign(a.quality - b.quality) * sign(a.n_chars - b.n_chars) < 0 THEN 1 ELSE 0 END) AS e,
  sum(CASE WHEN a.quality <> b.quality THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN a.n_chars <> b.n_chars THEN 1 ELSE 0 END) AS ny FROM j a JOIN j b ON a.doc_id < b.doc_id)
SELECT {r6('(c - e) / sqrt(CAST(nx AS DOUBLE) * ny)', 6)} AS tau FROM p""")
def kendall_tau_b(spark, d):
    return agreement.kendall_tau_b(verdicts(spark, d), "quality", "n_chars").select(S.rounded(F.col("tau")).alias("tau"))


@query(f"""WITH {VERDICT}, r AS (SELECT rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS a, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS b FROM j)
SELECT {r6('(avg(a::DOUBLE * b) - avg(a::DOUBLE) * avg(b::DOUBLE)) / sqrt((avg(a::DOUBLE * a) - avg(a::DOUBLE) * avg(a::DOUBLE)) * (avg(b::DOUBLE * b) - avg(b::DOUBLE) * avg(b::DOUBLE)))', 6)} AS rho FROM r""")
def spearman(spark, d):
    return agreement.spearman(verdicts(spark, d), "quality", "n_chars").select(S.rounded(F.col("rho")).alias("rho"))


@query(f"""WITH {VERDICT} SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality <> toxic) AS matched, {r6('avg(CASE WHEN quality <> toxic THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share, CAST(median(n_chars) AS DOUBLE) AS mid FROM j GROUP BY GROUPING SETS ((lang), ())""")
def agreement_grouping_sets(spark, d):
    j = verdicts(spark, d)
    hit = (F.col("quality") != F.col("toxic"))
    return j.rollup("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("matched"), S.rounded(F.avg(hit.cast("double"))).alias("share"), F.median("n_chars").alias("mid"))


@query("""SELECT source, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS repeats, CAST(sum(s * (s - 1) // 2 + (n - s) * (n - s - 1) // 2) AS BIGINT) AS agreeing FROM
  (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS s FROM labels JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY 1""")
def self_agreement(spark, d):
    """Pairs of answers to one question (source, lang) and those that agree, from counts instead of pairs."""
    c = verdicts(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("s"))
    return c.groupBy("source").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("repeats"), F.sum(F.expr("s * (s - 1) div 2 + (n - s) * (n - s - 1) div 2")).alias("agreeing"))


@query(f"WITH {VERDICT} SELECT quality, count(*) AS n, count(*) FILTER (WHERE n_chars >= 1000) AS beyond, {r6('avg(n_chars)', 4)} AS mean_gap FROM j GROUP BY 1")
def level_confound(spark, d):
    return verdicts(spark, d).groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 1000).alias("beyond"), S.rounded(F.avg("n_chars"), 4).alias("mean_gap"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_type = b.p_type THEN 'size' WHEN a.p_size = b.p_size THEN 'type' ELSE 'trade' END AS axis
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE (a.p_type = b.p_type OR a.p_size = b.p_size OR abs(a.p_size - b.p_size) <= 0.05 * greatest(a.p_size, b.p_size))""")
def pair_questions(spark, d):
    """Which axis a pair of renditions differs on, or a trade where their sizes match within the tolerance."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return listening.paired(p, "p_partkey", "p_brand", "p_type", "p_size", 0.05).select("a", "b", "axis")


@query("""SELECT p_brand, CAST(tile - 1 AS INT) AS share, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, tile ORDER BY p_size, p_partkey) AS rn FROM
  (SELECT p_brand, p_partkey, p_size, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS tile FROM part)) WHERE rn = 1""")
def pair_quota_shares(spark, d):
    """Equal shares by margin, and of each share the least-heard clip."""
    tiles = table(spark, d, "part").withColumn("share", F.ntile(4).over(W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")) - 1)
    return tiles.groupBy("p_brand", "share").agg(F.min(F.struct("p_size", "p_partkey")).alias("b")).select("p_brand", "share", F.col("b.p_partkey").alias("p_partkey"))


# streams in batch mode; rateloom.streaming runs the same plans on readStream


@query(f"SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, {r6('sum(value)', 3)} AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    from rateloom.streaming.windows import tumbling

    t = tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value")
    return t.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", S.rounded(F.col("total"), 3).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    from rateloom.streaming.windows import sessions

    s = sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["user_id"])
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
