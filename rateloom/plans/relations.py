"""Queries of the relational operators, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rateloom.functions import scalars as S
from rateloom.operators import relational as R
from rateloom.session import table

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {float(10**digits)}::DOUBLE + 0.5::DOUBLE) / {float(10**digits)}::DOUBLE + 0.0::DOUBLE"


def _dedupe(spark, d, keys):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", *LINE)
    return R.shortest_covering(rows, keys, "l_quantity", F.lit(25.0), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey"]).select(*keys, "l_orderkey", "l_linenumber", "l_quantity")


def _dedupe_sql(keys):
    k = ", ".join(keys)
    return f"""SELECT {k}, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY {k}
      ORDER BY l_quantity < 25, CASE WHEN l_quantity >= 25 THEN l_quantity ELSE -l_quantity END, l_orderkey, l_linenumber, l_extendedprice, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"""


@query(_dedupe_sql(["l_partkey"]))
def dedupe_shortest_covering(spark: SparkSession, d: str) -> DataFrame:
    return _dedupe(spark, d, ["l_partkey"])


@query(_dedupe_sql(["l_partkey", "l_returnflag"]))
def dedupe_identity_pitch(spark, d):
    return _dedupe(spark, d, ["l_partkey", "l_returnflag"])


@query(_dedupe_sql(["l_partkey", "l_returnflag", "l_linestatus"]))
def dedupe_identity_pitch_velocity(spark, d):
    return _dedupe(spark, d, ["l_partkey", "l_returnflag", "l_linestatus"])


EVEN = """CASE WHEN {k} >= n THEN i WHEN {k} = 1 THEN (n - 1) // 2 ELSE CAST(round_even(i * (n - 1) / greatest({k} - 1, 1), 0) AS BIGINT) END"""


@query(f"""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
p AS (SELECT DISTINCT c_nationkey, {EVEN.format(k=5)} AS rank FROM (SELECT DISTINCT c_nationkey, n, unnest(range(0, least(5, n))) AS i FROM r))
SELECT c_nationkey, c_custkey FROM r JOIN p USING (c_nationkey, rank)""")
def subset_even_ranks(spark, d):
    return R.even_ranks(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], F.lit(5))


@query("""WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT c_nationkey, n, unnest(range(1, least(n, 60) + 1)) AS turn FROM g),
k AS (SELECT c_nationkey, count(*) AS picks FROM (SELECT * FROM t ORDER BY turn, n DESC, c_nationkey LIMIT 60) GROUP BY 1)
SELECT c_nationkey, n, coalesce(picks, 0) AS picks FROM g LEFT JOIN k USING (c_nationkey)""")
def subset_waterfill_allotments(spark, d):
    groups = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return R.allotments(groups, "c_nationkey", "n", 60)


@query(f"""WITH a AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, total, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey) - 1 AS rank,
  count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem JOIN a USING (l_suppkey) WHERE l_quantity >= 10),
q AS (SELECT DISTINCT l_suppkey, n, CAST(least(n, greatest(1, round_even(0.1::DOUBLE * total, 0))) AS BIGINT) AS k FROM r),
p AS (SELECT DISTINCT l_suppkey, {EVEN.format(k='k')} AS rank FROM (SELECT *, unnest(range(0, k)) AS i FROM q))
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM r JOIN p USING (l_suppkey, rank)""")
def subset_floor_then_fraction(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", *LINE[:4])
    counts = rows.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    kept = rows.where("l_quantity >= 10").join(counts, "l_suppkey")
    picks = F.greatest(F.lit(1), F.bround(F.col("total") * 0.1, 0).cast("long"))
    return R.even_ranks(kept, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey"], picks).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT event_type, CAST(CASE WHEN value > 0 THEN ceil(ln(value) / ln(1.25::DOUBLE) - 1e-9::DOUBLE) END AS BIGINT) AS step, count(*) AS n, CAST(sum(event_id % 5 + 1) AS BIGINT) AS weight, max(user_id) AS top_user FROM events GROUP BY ALL""")
def merge_geometric_buckets(spark, d):
    ev = table(spark, d, "events")
    step = F.when(F.col("value") > 0, F.round(F.ln(S.bucket_edge(F.col("value"), 1.25)) / F.ln(F.lit(1.25))).cast("long"))
    return ev.groupBy("event_type", step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 5 + 1).alias("weight"), F.max("user_id").alias("top_user"))


@query("""SELECT l_partkey, CAST(ceil(l_quantity / 10) AS BIGINT) AS bucket, CAST(sum(l_linenumber) AS BIGINT) AS weight, max(l_quantity) AS longest, count(*) AS merged FROM lineitem GROUP BY ALL""")
def merge_class_weights(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_partkey", F.ceil(F.col("l_quantity") / 10).alias("bucket")).agg(F.sum("l_linenumber").alias("weight"), F.max("l_quantity").alias("longest"), F.count("*").alias("merged"))


@query("""SELECT c_custkey, c_nationkey, s_acctbal AS nearest_value, s_suppkey AS nearest_key FROM (SELECT c_custkey, c_nationkey, s_acctbal, s_suppkey,
  row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_acctbal, s_suppkey) AS rn FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE rn = 1""")
def nearest_key_join(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal", "s_suppkey")
    out = R.nearest_join(left, right, ["nation"], "bal", "s_acctbal", "s_suppkey").where("nearest_key is not null")
    return out.select("c_custkey", F.col("nation").alias("c_nationkey"), "nearest_value", "nearest_key")


@query("""WITH k AS (SELECT DISTINCT p_type, p_size FROM part), g AS (SELECT DISTINCT p_type FROM k), f AS (SELECT p_type, unnest(range(0, 61)) AS key FROM g)
SELECT p_type, key, p_size AS answered FROM (SELECT f.p_type, key, p_size, row_number() OVER (PARTITION BY f.p_type, key ORDER BY abs(p_size - key), p_size DESC) AS rn FROM f JOIN k USING (p_type)) WHERE rn = 1""")
def nearest_fill_higher_ties(spark, d):
    """The same keyboard where of two keys as near the higher one answers."""
    keys = table(spark, d, "part").select("p_type", F.col("p_size").cast("long").alias("p_size")).distinct()
    board = keys.select("p_type").distinct().withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"))))
    out = R.nearest_join(board, keys.withColumn("own", F.col("p_size")), ["p_type"], "key", "p_size", "own", ties="higher")
    return out.select("p_type", "key", F.col("nearest_key").cast("int").alias("answered"))


@query("""WITH k AS (SELECT DISTINCT p_type, p_size FROM part), g AS (SELECT DISTINCT p_type FROM k), f AS (SELECT p_type, unnest(range(0, 61)) AS key FROM g)
SELECT p_type, key, p_size AS answered FROM (SELECT f.p_type, key, p_size, row_number() OVER (PARTITION BY f.p_type, key ORDER BY abs(p_size - key), p_size) AS rn FROM f JOIN k USING (p_type)) WHERE rn = 1""")
def nearest_fill_keyboard(spark, d):
    keys = table(spark, d, "part").select("p_type", F.col("p_size").cast("long").alias("p_size")).distinct()
    board = keys.select("p_type").distinct().withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"))))
    out = R.nearest_join(board, keys.withColumn("own", F.col("p_size")), ["p_type"], "key", "p_size", "own")
    return out.select("p_type", "key", F.col("nearest_key").cast("int").alias("answered"))


@query("""SELECT l_returnflag, CAST(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 35 THEN 2 WHEN l_quantity <= 48 THEN 3 END AS INT) AS band, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS weight
FROM lineitem GROUP BY ALL""")
def band_range_join(spark, d):
    edges = F.array(*(F.lit(float(e)) for e in (10, 20, 35, 48)))
    rows = table(spark, d, "lineitem").withColumn("band", R.first_band(F.col("l_quantity"), edges).cast("int"))
    return rows.groupBy("l_returnflag", "band").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("weight"))


@query("""WITH c AS (SELECT p_brand, p_size, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1) // 8 AS INT) AS chunk FROM (SELECT DISTINCT p_brand, p_size FROM part)),
s AS (SELECT p_brand, chunk, min(p_size) AS low, max(p_size) AS high, count(*) AS n FROM c GROUP BY ALL)
SELECT p_brand, chunk, CASE WHEN chunk = 0 THEN 0 ELSE low END AS low, coalesce(lead(low) OVER (PARTITION BY p_brand ORDER BY chunk) - 1, 127) AS high, n FROM s""")
def slot_key_tiling(spark, d):
    keys = R.chunks(table(spark, d, "part").select("p_brand", "p_size").distinct(), ["p_brand"], "p_size", 8)
    slots = keys.groupBy("p_brand", "chunk").agg(F.min("p_size").alias("low"), F.count("*").alias("n"))
    nxt = F.lead("low").over(W.partitionBy("p_brand").orderBy("chunk")) - 1
    return slots.select("p_brand", "chunk", F.when(F.col("chunk") == 0, 0).otherwise(F.col("low")).alias("low"), F.coalesce(nxt, F.lit(127)).alias("high"), "n")


@query("""WITH k AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT a.p_brand, a.p_size AS start, b.p_size AS stop, CAST(b.r - a.r + 1 AS INT) AS n_keys FROM k a JOIN k b ON a.p_brand = b.p_brand AND b.p_size BETWEEN a.p_size AND a.p_size + 6""")
def zone_candidates_span_cap(spark, d):
    return R.runs_within_span(table(spark, d, "part"), ["p_brand"], "p_size", 6)


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def semi_playable(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_dropped_notes(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left_anti")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS orphans FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def orphan_check(spark, d):
    found = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return found.agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"))


@query("""WITH w AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM w)
SELECT l_returnflag, CAST(cell AS INT) AS cell, min(l_quantity) AS edge FROM c, (SELECT unnest([1, 2, 3, 4]) AS cell) WHERE cum * 5 >= total * cell GROUP BY ALL""")
def equal_share_bands(spark, d):
    return R.equal_share_cuts(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber", 5)


@query("""SELECT CAST(bit_count(id) + 1 AS INT) AS bands, array_to_string(list_concat(list_filter(range(0, 5), lambda i: (id >> i) & 1 = 1), [5::BIGINT]), '-') AS ends FROM (SELECT unnest(range(0, 32)) AS id) WHERE bit_count(id) < 3""")
def layer_partitions_enumerated(spark, d):
    return R.compositions(spark, 6, 3)


FRONT = """b AS (SELECT p_brand, p_size, min(p_retailprice) AS p_retailprice FROM part GROUP BY ALL),
front AS (SELECT p_brand, p_size, p_retailprice FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b) WHERE seen IS NULL OR p_retailprice < seen - 1e-12::DOUBLE)"""
HULL = FRONT + """,
slopes AS (SELECT p.p_brand, p.p_size, p.p_retailprice, max(CASE WHEN a.p_size < p.p_size THEN (p.p_retailprice - a.p_retailprice) / (p.p_size - a.p_size) END) AS before,
  min(CASE WHEN a.p_size > p.p_size THEN (a.p_retailprice - p.p_retailprice) / (a.p_size - p.p_size) END) AS after FROM front p JOIN front a USING (p_brand) GROUP BY ALL),
hull AS (SELECT p_brand, p_size, p_retailprice FROM slopes WHERE before IS NULL OR after IS NULL OR before < after)"""
CURVE = HULL + """,
up AS (SELECT p_brand, p_size, p_size - lag(p_size) OVER w AS more, lag(p_retailprice) OVER w - p_retailprice AS less FROM hull WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)),
steps AS (SELECT *, row_number() OVER (ORDER BY less / more DESC, p_brand, p_size) AS step FROM up WHERE more IS NOT NULL),
base AS (SELECT sum(p_size) AS c0, sum(p_retailprice) AS l0 FROM (SELECT p_brand, min(p_size) AS p_size, arg_min(p_retailprice, p_size) AS p_retailprice FROM hull GROUP BY 1)),
curve AS (SELECT 0 AS step, c0 AS total_cost, l0 AS total_loss FROM base UNION ALL
  SELECT step, c0 + sum(more) OVER (ORDER BY step), l0 - sum(less) OVER (ORDER BY step) FROM steps, base)"""


@query(f"WITH {FRONT} SELECT * FROM front")
def pareto_frontier(spark, d):
    return R.pareto_frontier(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice")


@query(f"WITH {HULL} SELECT * FROM hull")
def lower_hull(spark, d):
    return R.lower_hull(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice")


def _curve(spark, d):
    return R.lagrangian_curve(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice")


@query(f"WITH {CURVE} SELECT CAST(step AS INT) AS step, CAST(total_cost AS BIGINT) AS total_cost, {r6('total_loss', 4)} AS total_loss FROM curve")
def lagrangian_curve(spark, d):
    return _curve(spark, d).select("step", F.col("total_cost").cast("long").alias("total_cost"), S.rounded(F.col("total_loss"), 4).alias("total_loss"))


@query(f"WITH {CURVE} SELECT CAST(max(step) AS INT) AS step, CAST(max(total_cost) AS BIGINT) AS total_cost, {r6('min(total_loss)', 4)} AS total_loss FROM curve WHERE total_cost <= 400")
def lagrangian_budget(spark, d):
    fits = _curve(spark, d).where("total_cost <= 400")
    return fits.agg(F.max("step").alias("step"), F.max("total_cost").cast("long").alias("total_cost"), S.rounded(F.min("total_loss"), 4).alias("total_loss"))


CHOICE = """pts AS (SELECT p_brand, p_size, min(p_retailprice) AS loss, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS item FROM part GROUP BY p_brand, p_type, p_size),
bud AS (SELECT p_brand, CAST(sum(m) + 12 AS BIGINT) AS budget, max(item) AS items FROM (SELECT p_brand, item, min(p_size) AS m FROM pts GROUP BY ALL) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {CHOICE}, walk AS (SELECT p_brand, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS bytes, 0.0::DOUBLE AS loss FROM bud UNION ALL
  SELECT w.p_brand, w.done + 1, w.bytes + p.p_size, min(w.loss + p.loss) FROM walk w JOIN pts p ON p.p_brand = w.p_brand AND p.item = w.done + 1 JOIN bud ON bud.p_brand = w.p_brand
  WHERE w.bytes + p.p_size <= budget GROUP BY w.p_brand, w.done + 1, w.bytes + p.p_size)
SELECT w.p_brand, {r6('min(loss)', 4)} AS loss FROM walk w JOIN bud USING (p_brand) WHERE done = items GROUP BY 1""")
def mckp_exact_small(spark, d):
    """A size for every type of a brand, within twelve bytes of the cheapest choice."""
    from rateloom.operators.solve import exact_choice

    points = table(spark, d, "part").groupBy("p_brand", "p_type", F.col("p_size").cast("long").alias("p_size")).agg(F.min("p_retailprice").alias("loss"))
    least = points.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("m")).groupBy("p_brand").agg((F.sum("m") + 12).alias("budget"))
    return exact_choice(points.join(least, "p_brand"), "p_brand", "p_type", "p_size", "loss", "budget").select("p_brand", S.rounded(F.col("loss"), 4).alias("loss"))


ZONE_BUDGET, CAP_BUDGET = 90, 60
ZONES = """k AS (SELECT p_brand, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS INT) AS r FROM (SELECT DISTINCT p_brand, p_size FROM part)),
zone AS (SELECT a.p_brand, a.r AS start, b.r AS stop, 10 + (b.p_size - a.p_size) AS bytes, CAST((b.p_size - a.p_size) * (b.p_size - a.p_size) AS DOUBLE) AS loss FROM k a JOIN k b USING (p_brand) WHERE b.r >= a.r),
n AS (SELECT p_brand, max(r) AS top FROM k GROUP BY 1)"""


def zone_walk(budget: int, most: int | None = None) -> str:
    """All cuts of a brand's sizes, a zone more in each step; of cuts alike in end and bytes the best goes on."""
    limit = f" AND w.used < {most}" if most else ""
    return f"""{ZONES}, walk AS (SELECT p_brand, -1 AS done, CAST(0 AS BIGINT) AS bytes, 0.0::DOUBLE AS loss, 0 AS used FROM n UNION ALL
  SELECT w.p_brand, z.stop, w.bytes + z.bytes, min(w.loss + z.loss), w.used + 1 FROM walk w JOIN zone z ON z.p_brand = w.p_brand AND z.start = w.done + 1
  WHERE w.bytes + z.bytes <= {budget}{limit} GROUP BY w.p_brand, z.stop, w.bytes + z.bytes, w.used + 1)
SELECT w.p_brand, min(loss) AS loss FROM walk w JOIN n USING (p_brand) WHERE done = top GROUP BY 1"""


def _size_zones(spark, d):
    keys = table(spark, d, "part").select("p_brand", "p_size").distinct()
    keys = keys.withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy("p_size")) - 1)
    a, b = keys.alias("a"), keys.alias("b")
    width = F.col("b.p_size") - F.col("a.p_size")
    return a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("b.r") >= F.col("a.r"))).select(
        F.col("a.p_brand").alias("p_brand"), F.col("a.r").alias("start"), F.col("b.r").alias("stop"), (width + 10).alias("bytes"), (width * width).cast("double").alias("loss"))


@query(f"WITH RECURSIVE {zone_walk(ZONE_BUDGET)}")
def partition_dp_small(spark, d):
    from rateloom.operators.solve import exact_partition

    return exact_partition(_size_zones(spark, d), "p_brand", ZONE_BUDGET).select("p_brand", "loss")


@query(f"WITH RECURSIVE {zone_walk(CAP_BUDGET, 2)}")
def sample_cap_search(spark, d):
    """At most two zones: the count limit enters the partition's own table."""
    from rateloom.operators.solve import exact_partition

    return exact_partition(_size_zones(spark, d), "p_brand", CAP_BUDGET, most=2).select("p_brand", "loss")


@query(f"SELECT p_brand, {r6('coalesce(sum(p_retailprice * p_size) / nullif(sum(p_size), 0), 0)', 4)} AS distortion, CAST(sum(p_size) AS BIGINT) AS weight FROM part GROUP BY 1")
def weighted_distortion(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(S.rounded(R.weighted_mean(F.col("p_retailprice"), F.col("p_size")), 4).alias("distortion"), F.sum("p_size").alias("weight"))


@query(f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INT) AS depth, {r6('sum(l_linenumber * l_quantity) / sum(l_linenumber)', 5)} AS objective, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def objective_by_layer(spark, d):
    rolled = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rolled.agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int").alias("depth"), S.rounded(R.weighted_mean(F.col("l_quantity"), F.col("l_linenumber")), 5).alias("objective"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, min(c_acctbal) AS least, max(c_acctbal) AS most, count(DISTINCT c_nationkey) AS nations, count(*) AS n FROM customer GROUP BY 1")
def played_keys_by_group(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.count_distinct("c_nationkey").alias("nations"), F.count("*").alias("n"))


@query("SELECT l_partkey, max(l_quantity) AS longest FROM lineitem GROUP BY 1")
def longest_note_by_pitch(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("longest"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_quantity DESC, l_orderkey, l_extendedprice, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def representative_event(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", *LINE)
    return R.first_by(rows, ["l_partkey"], [-F.col("l_linenumber"), -F.col("l_quantity"), F.col("l_orderkey"), F.col("l_extendedprice"), F.col("l_suppkey")]).select("l_partkey", "l_orderkey", "l_linenumber")


# scalars


@query("""SELECT p_partkey, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][(p_size + 40) % 12 + 1] || CAST(CAST(floor((p_size + 40) / 12) AS INT) - 1 AS VARCHAR) AS name, 'p' || lpad(CAST(p_size + 40 AS VARCHAR), 3, '0') AS label FROM part""")
def note_name(spark, d):
    pitch = F.col("p_size") + 40
    return table(spark, d, "part").select("p_partkey", S.note_name(pitch).alias("name"), F.substring_index(S.pitch_label(pitch), "_", 1).alias("label"))


@query("SELECT p_partkey, p_size + 40 AS pitch FROM part")
def named_pitch_parse(spark, d):
    return table(spark, d, "part").select("p_partkey", S.named_pitch(S.note_name(F.col("p_size") + 40)).cast("int").alias("pitch"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '#(\\d+)', 1) AS INT) AS number, CAST(c_nationkey AS INT) AS pitch, CAST(c_custkey % 128 AS INT) AS velocity FROM customer")
def token_parse(spark, d):
    name = F.concat(F.lit("take_p"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit("_v"), (F.col("c_custkey") % 128).cast("string"), F.lit(".wav"))
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", r"#(\d+)", 1).cast("int").alias("number"), S.first_token(name, "p").alias("pitch"), S.first_token(name, "v").alias("velocity"))


@query("SELECT event_id, '[' || 'k:' || CAST(CAST(floor(CAST(json_extract(props, '$.k') AS INT) / 8.0) AS INT) AS VARCHAR) || ']' AS identity FROM events")
def cc_buckets(spark, d):
    pairs = S.controller_buckets(F.from_json("props", "map<string,double>"), 8.0)
    text = F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["cc"], p["bucket"].cast("string"))), ","), F.lit("]"))
    return table(spark, d, "events").select("event_id", text.alias("identity"))


@query("SELECT p_partkey, 'zone' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '_rep' || lpad(CAST(p_size + 40 AS VARCHAR), 3, '0') || '_' || ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][(p_size + 40) % 12 + 1] || CAST(CAST(floor((p_size + 40) / 12) AS INT) - 1 AS VARCHAR) AS label FROM part")
def label_format(spark, d):
    return table(spark, d, "part").select("p_partkey", S.zone_label(F.col("p_partkey") % 100, F.col("p_size") + 40).alias("label"))


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, {r6('20 * log10(greatest(pow(10::DOUBLE, (-l_quantity) / 20), 1e-12::DOUBLE))', 6)} AS db FROM lineitem")
def db_gain_roundtrip(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", S.rounded(S.gain_to_db(S.db_to_gain(-F.col("l_quantity")))).alias("db"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(round_even(l_quantity / 7 * 30, 0) AS BIGINT) AS frames, CAST(ceil(l_quantity * 1024) AS BIGINT) AS bytes, CAST(ceil(l_quantity * 1000 / 16) AS BIGINT) AS steps FROM lineitem")
def grid_costs(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", S.seconds_to_frames(q / 7, 30.0).alias("frames"), S.kib_to_bytes(q).alias("bytes"), S.grid_cost(q * 1000, 1000, 64).alias("steps"))


# sets and reports


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents WHERE n_chars < 1000 UNION ALL SELECT source, lang FROM documents WHERE n_chars >= 500) GROUP BY ALL")
def stage_union(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "n_chars")
    return docs.where("n_chars < 1000").unionByName(docs.where("n_chars >= 500")).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list_concat(list(p_size) FILTER (WHERE p_size <= 20), list(p_size) FILTER (WHERE p_size >= 15)))), ',') AS rates FROM part GROUP BY 1")
def set_union_rates(spark, d):
    low, high = (F.collect_set(F.when(c, F.col("p_size"))) for c in (F.col("p_size") <= 20, F.col("p_size") >= 15))
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.array_union(low, high)), ",").alias("rates"))


@query("SELECT source, min(doc_id) AS first_doc, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents GROUP BY 1")
def distinct_first_seen(spark, d):
    firsts = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return firsts.withColumn("place", F.row_number().over(W.orderBy("first_doc")).cast("long"))


@query("SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#11' EXCEPT SELECT p_size FROM part WHERE p_brand = 'Brand#12'")
def candidate_keys_except(spark, d):
    part = table(spark, d, "part")
    return part.where("p_brand = 'Brand#11'").select("p_size").subtract(part.where("p_brand = 'Brand#12'").select("p_size"))


STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _star(spark, d):
    line, orders, cust, nation, region = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    out = line.join(orders, line.l_orderkey == orders.o_orderkey).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return out.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"SELECT r_name, l_returnflag, count(*) AS before_rows, count(*) FILTER (WHERE l_quantity >= 25) AS after_rows, count(DISTINCT l_partkey) AS keys FROM {STAR} GROUP BY ALL")
def report_reduction_axes(spark, d):
    return _star(spark, d).groupBy("r_name", "l_returnflag").agg(F.count("*").alias("before_rows"), F.count_if(F.col("l_quantity") >= 25).alias("after_rows"), F.count_distinct("l_partkey").alias("keys"))


@query(f"SELECT r_name, n_name, CAST(u AS BIGINT) AS used, {r6('u / sum(u) OVER (PARTITION BY r_name)')} AS share FROM (SELECT r_name, n_name, sum(l_quantity) AS u FROM {STAR} GROUP BY ALL)")
def report_budget(spark, d):
    used = _star(spark, d).groupBy("r_name", "n_name").agg(F.sum("l_quantity").alias("u"))
    share = F.col("u") / F.sum("u").over(W.partitionBy("r_name"))
    return used.select("r_name", "n_name", F.col("u").cast("long").alias("used"), S.rounded(share).alias("share"))


@query("SELECT 'pitch' AS kind, p_brand AS label, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY ALL UNION ALL SELECT 'zone', p_type, count(*), CAST(sum(p_size) AS BIGINT) FROM part GROUP BY ALL")
def report_items_union(spark, d):
    part = table(spark, d, "part")
    one = lambda kind, c: part.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("label")).agg(F.count("*").alias("n"), F.sum("p_size").alias("bytes"))
    return one("pitch", "p_brand").unionByName(one("zone", "p_type"))


@query("SELECT l_partkey, l_linenumber AS copy_of, CAST(count(*) AS BIGINT) AS notes FROM (SELECT l_partkey, l_linenumber, unnest(range(0, l_linenumber)) AS k FROM lineitem) GROUP BY ALL")
def explode_events(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", F.explode(F.sequence(F.lit(1), F.col("l_linenumber"))).alias("k"))
    return rows.groupBy("l_partkey", F.col("l_linenumber").alias("copy_of")).agg(F.count("*").alias("notes"))
