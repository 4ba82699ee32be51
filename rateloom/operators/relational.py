"""Relational operators: identity dedupe, stratified ranks, nearest and range joins, bands, frontiers, hulls, upgrades.

Where an operator keeps one row of a group it is an aggregate over a struct, so that rows are combined before the
shuffle; windows are left to what needs an order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
#: Ranges into which an axis is cut where one task should not sort it all.
BUCKETS = 64


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes first in a total order."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)), *rest)
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_best.{c}") for c in df.columns))


def shortest_covering(df: DataFrame, keys: list[str], length: str, required: Column, ties: list[str]) -> DataFrame:
    """Of each identity the shortest row that covers what is required, else the longest; ties by the given columns."""
    covers = F.col(length) >= required
    return first_by(df, keys, [(~covers).cast("int"), F.when(covers, F.col(length)).otherwise(-F.col(length)), *map(F.col, ties)])


def even_rank(index: Column, picks: Column, count: Column) -> Column:
    """Place of the index-th of picks ranks spread over count places, both ends included; one pick takes the middle."""
    spread = F.bround(index * (count - 1) / F.greatest(picks - 1, F.lit(1)), 0).cast("long")
    return F.when(picks >= count, index).when(picks == 1, F.floor((count - 1) / 2)).otherwise(spread)


def even_ranks(df: DataFrame, keys: list[str], order: list[str], picks: Column) -> DataFrame:
    """Rows of each group at evenly spread ranks. picks may differ by group."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_rank": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w), "_k": picks})
    k = F.least("_k", "_n")
    places = F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: even_rank(i, F.col("_k"), F.col("_n")))
    return ranked.where((k > 0) & F.array_contains(places, F.col("_rank").cast("long"))).drop("_rank", "_n", "_k")


def allotments(groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Picks of each group: one each, then round after round from the busiest on, none beyond its size.

    With no more picks than groups, evenly spread groups (in key order) get one. groups: one row a group.
    """
    n = groups.count()
    if total <= n:
        chosen = even_ranks(groups.withColumn("_all", F.lit(0)), ["_all"], [key], F.lit(total)).select(key, F.lit(1).cast("long").alias("picks"))
        return groups.join(chosen, key, "left").fillna(0, ["picks"])
    turns = groups.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.least(F.col(size), F.lit(total)).cast("int"))))
    given = turns.orderBy("_turn", F.desc(size), key).limit(total).groupBy(key).agg(F.count("*").alias("picks"))
    return groups.join(given, key, "left").fillna(0, ["picks"])


def range_bucket(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """Number of the value range that a row falls into; the ranges hold about equal shares. The driver sees their edges only."""
    shares = [k / buckets for k in range(1, buckets)]
    edges = sorted(set(df.agg(F.percentile_approx(column, shares, 10 * buckets)).first()[0] or []))
    value = F.col(column)
    # equal values never part: an edge counts as passed by what lies above it
    passed = [(value > F.lit(e)).cast("int") for e in edges]
    return reduce(lambda a, b: a + b, passed) if passed else F.when(value.isNotNull(), 0)


def running_total(df: DataFrame, order: str, value: str, into: str, buckets: int = BUCKETS) -> DataFrame:
    """Sum of a column over all rows up to each one's distinct value of order, without sorting the table in one task.

    Ranges of values are summed by themselves, and the ranges' totals give what lies before each.
    """
    ranged = df.withColumn("_b", range_bucket(df, order, buckets))
    totals = ranged.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    here = Window.partitionBy("_b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("_s", F.sum(value).over(here))
    return inside.join(F.broadcast(offsets), "_b").withColumn(into, F.col("_o") + F.col("_s")).drop("_b", "_o", "_s")


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, right_key: str, buckets: int = BUCKETS, ties: str = "lower") -> DataFrame:
    """For each left row the right row of its group with the nearest value; of two as near the lower value wins, or the
    higher one with ties="higher"; of equal values the lower key.

    Both sides are sorted together once and each left row looks one way and the other: no pairs are made. The axis is
    cut into ranges, so that a large group is many tasks; what lies beyond a range's ends comes from the ranges' own
    first and last right values.
    """
    side = right.groupBy(*by, F.col(right_on).alias("_v")).agg(F.min(right_key).alias("_key"))
    bucket = range_bucket(side, "_v", buckets)
    rows = left.withColumn("_row", F.struct(*left.columns))
    both = rows.select(*by, F.col(on).cast(side.schema["_v"].dataType).alias("_v"), "_row", F.lit(None).cast(side.schema["_key"].dataType).alias("_key")).unionByName(
        side.select(*by, "_v", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_key"))
    both = both.withColumn("_b", bucket)
    mark = F.when(F.col("_key").isNotNull(), F.struct("_v", "_key"))
    ends = both.groupBy(*by, "_b").agg(F.max(mark).alias("_top"), F.min(mark).alias("_low"))
    across = Window.partitionBy(*by).orderBy("_b")
    ends = ends.select(
        *by, "_b", F.last("_top", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_low", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    # the nearest right rows outside a range stand in it as well
    guests = ends.select(*by, "_b", F.explode(F.array_compact(F.array("_before", "_after"))).alias("_g"))
    nobody = F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    both = both.unionByName(guests.select(*by, F.col("_g._v").alias("_v"), nobody, F.col("_g._key").alias("_key"), "_b"))
    w = Window.partitionBy(*by, "_b").orderBy("_v")
    # peers of a value are in range frames, so a right row of the same value is seen both ways
    below = F.last(mark, True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first(mark, True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumns({"_lo": below, "_hi": above}).where("_row is not null")
    low, high = F.abs(F.col("_v") - F.col("_lo._v")), F.abs(F.col("_hi._v") - F.col("_v"))
    upper = high <= low if ties == "higher" else high < low
    pick = F.when(F.col("_v").isNull(), F.lit(None)).when(F.col("_lo").isNull() | upper, F.col("_hi")).otherwise(F.col("_lo"))
    return found.withColumn("_pick", pick).select("_row.*", F.col("_pick._v").alias("nearest_value"), F.col("_pick._key").alias("nearest_key"))


def first_band(value: Column, edges: Column) -> Column:
    """Number of the first band whose upper edge reaches the value; edges is a sorted array. Null above the top."""
    inside = F.size(F.filter(edges, lambda e: e < value))
    return F.when(inside < F.size(edges), inside)


def equal_share_cuts(df: DataFrame, keys: list[str], axis: str, weight: str, cells: int) -> DataFrame:
    """(keys, cell, edge): the axis value at which each of the first cells - 1 equal shares of the weight is reached."""
    by_value = df.groupBy(*keys, axis).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    cum = by_value.withColumns({"_cum": F.sum("_w").over(w.orderBy(axis)), "_all": F.sum("_w").over(w)})
    cuts = cum.withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(cells - 1))))
    return cuts.where(F.col("_cum") * cells >= F.col("_all") * F.col("cell")).groupBy(*keys, "cell").agg(F.min(axis).alias("edge"))


def pareto_frontier(df: DataFrame, keys: list[str], cost: str, loss: str) -> DataFrame:
    """Points with strictly less loss than every cheaper one. Equal costs collapse to their best before any window."""
    best = df.groupBy(*keys, cost).agg(F.min(loss).alias(loss))
    w = Window.partitionBy(*keys).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_seen", F.min(loss).over(w)).where(F.col("_seen").isNull() | (F.col(loss) < F.col("_seen") - EPSILON)).drop("_seen")


def lower_hull(df: DataFrame, keys: list[str], cost: str, loss: str) -> DataFrame:
    """Vertices of the frontier's lower convex hull: the steepest way in is steeper than the flattest way out."""
    points = F.array_sort(F.collect_list(F.struct(F.col(cost).alias("x"), F.col(loss).alias("y"))))
    lists = pareto_frontier(df, keys, cost, loss).groupBy(*keys).agg(points.alias("_p"))
    slope = lambda a, b: (b["y"] - a["y"]) / (b["x"] - a["x"])

    def vertex(p: Column) -> Column:
        before = F.array_max(F.transform(F.filter("_p", lambda a: a["x"] < p["x"]), lambda a: slope(a, p)))
        after = F.array_min(F.transform(F.filter("_p", lambda b: b["x"] > p["x"]), lambda b: slope(p, b)))
        return F.coalesce(before < after, F.lit(True))

    kept = lists.select(*keys, F.explode(F.filter("_p", vertex)).alias("_v"))
    return kept.select(*keys, F.col("_v.x").alias(cost), F.col("_v.y").alias(loss))


def upgrades(hull: DataFrame, keys: list[str], cost: str, loss: str, weight: Column | None = None) -> DataFrame:
    """Steps between neighbouring hull vertices: bytes more, loss less, gain per byte."""
    w = Window.partitionBy(*keys).orderBy(cost)
    scale = F.lit(1.0) if weight is None else weight
    steps = hull.withColumns({"_c": F.lag(cost).over(w), "_l": F.lag(loss).over(w)}).where("_c is not null")
    steps = steps.withColumns({"more": F.col(cost) - F.col("_c"), "less": (F.col("_l") - F.col(loss)) * scale})
    return steps.withColumn("gain", F.col("less") / F.col("more")).drop("_c", "_l")


def lagrangian_curve(df: DataFrame, keys: list[str], cost: str, loss: str) -> DataFrame:
    """Rate-distortion curve: every item at its cheapest, then the steepest upgrades first. One row a step.

    The order is global by nature, but it runs over hull vertices only, after groups have collapsed to their hulls.
    """
    hull = lower_hull(df, keys, cost, loss)
    start = first_by(hull, keys, [F.col(cost)]).agg(F.sum(cost).alias("_c0"), F.sum(loss).alias("_l0"))
    w = Window.orderBy(F.desc("gain"), *keys, cost)
    steps = upgrades(hull, keys, cost, loss).withColumn("step", F.row_number().over(w))
    run = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = steps.withColumns({"_c": F.sum("more").over(run), "_l": F.sum("less").over(run)})
    curve = curve.crossJoin(F.broadcast(start))  # one row
    first = start.select(F.lit(0).alias("step"), F.col("_c0").alias("total_cost"), F.col("_l0").alias("total_loss"))
    return first.unionByName(curve.select("step", (F.col("_c0") + F.col("_c")).alias("total_cost"), (F.col("_l0") - F.col("_l")).alias("total_loss")))


def runs_within_span(df: DataFrame, keys: list[str], key: str, cap: int) -> DataFrame:
    """(start, stop) of all runs of distinct keys whose span is at most the cap, with the number of keys inside.

    A key joins the runs of its neighbours only: both sides meet in buckets as wide as the cap.
    """
    own = df.select(*keys, F.col(key).alias("_k")).distinct().withColumn("_b", F.floor(F.col("_k") / (cap + 1)))
    rank = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_k")))
    stops = rank.select(*keys, F.col("_k").alias("stop"), F.col("_r").alias("_r2"), F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"))
    joined = rank.join(stops, [*keys, "_b"])
    inside = joined.where((F.col("stop") >= F.col("_k")) & (F.col("stop") - F.col("_k") <= cap))
    return inside.select(*keys, F.col("_k").alias("start"), "stop", (F.col("_r2") - F.col("_r") + 1).alias("n_keys"))


def chunks(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Ordered rows of each group in runs of at most size; `chunk` numbers them from 0."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("chunk", F.floor(place / size).cast("int"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def compositions(spark, cells: int, most: int) -> DataFrame:
    """All ways to cut a row of cells into at most `most` bands, fewest first: number, bands, and the bands' last cells."""
    masks = spark.range(1 << (cells - 1)).where(F.bit_count("id") < most)
    ends = F.concat(F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(cells - 2, 0))), lambda i: F.when(F.call_function("shiftright", F.col("id"), i.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, i)), lambda i: i.isNotNull()), F.array(F.lit(cells - 1)))
    return masks.select((F.bit_count("id") + 1).alias("bands"), F.array_join(ends.cast("array<string>"), "-").alias("ends"))

