"""Listening sets: which pairs to ask, quotas over their margins, blinded order with repeats, and the report."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Renditions in a block: the pairs of two blocks stand in memory at once. Pairs of a clip, asked or not, that make a task; tasks at most.
BLOCK = 256
TASK_PAIRS = 1 << 25
MOST_TASKS = 20_000


def questions(renditions: DataFrame, clip: str, axes: list[str], size: str, tolerance: float) -> DataFrame:
    """Pairs of one clip that differ on a single axis, or trade several at sizes that match within the tolerance."""
    a, b = renditions.alias("a"), renditions.alias("b")
    pairs = a.join(b, (F.col(f"a.{clip}") == F.col(f"b.{clip}")) & (F.col("a.id") < F.col("b.id")))
    differ = F.filter(F.array(*(F.when(~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), F.lit(x)) for x in axes)), lambda x: x.isNotNull())
    large, small = F.greatest(f"a.{size}", f"b.{size}"), F.least(f"a.{size}", f"b.{size}")
    axis = F.when(F.size(differ) == 1, F.get(differ, F.lit(0))).when((F.size(differ) > 1) & (large - small <= large * tolerance), F.lit("trade"))
    return pairs.select(F.col(f"a.{clip}").alias(clip), F.col("a.id").alias("a"), F.col("b.id").alias("b"), axis.alias("axis")).where("axis is not null")


def packed(renditions: DataFrame, keys: list[str], order: list[str], item: Column) -> DataFrame:
    """(keys, block, items): the items of each group in arrays of at most BLOCK, by the order given."""
    ranked = renditions.withColumn("block", F.expr(f"(row_number() over (partition by {', '.join(f'`{k}`' for k in keys)} order by {', '.join(f'`{k}`' for k in order)}) - 1) div {BLOCK}"))
    return ranked.groupBy(*keys, "block").agg(F.collect_list(item).alias("items"))


def paired(renditions: DataFrame, key: str, clip: str, kind: str, size: str, tolerance: float) -> DataFrame:
    """(a, b, axis), a < b: the pairs of a clip of one kind ('size'), else of one size ('type') or of sizes that match ('trade').

    Blocks of renditions meet, not single ones, and are dealt out to as many tasks as the pairs need; each pair comes up once.
    """
    p = renditions.where(F.col(key).isNotNull() & F.col(clip).isNotNull()).select(F.col(key).alias("id"), F.col(clip).alias("clip"), F.col(kind).alias("kind"), F.col(size).alias("size"))
    near = near_sizes(p, "clip", "size", tolerance).where(F.col("size") <= F.col("other")).alias("n")
    square = p.groupBy("clip").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0
    tasks = int(min(MOST_TASKS, 1 + square // TASK_PAIRS))
    lone = lambda ids: F.array(F.struct(F.lit(None).cast(p.schema["kind"].dataType).alias("kind"), ids.alias("ids")))
    typed = packed(p.where("kind is not null"), ["clip", "kind"], ["id"], F.col("id"))
    l, r = typed.alias("l"), typed.alias("r")
    same = (F.col("l.clip") == F.col("r.clip")) & (F.col("l.kind") == F.col("r.kind")) & (F.col("l.block") <= F.col("r.block"))
    by_kind = l.join(r, same).select(lone(F.col("l.items")).alias("x"), lone(F.col("r.items")).alias("y"), (F.col("l.block") == F.col("r.block")).alias("own"), F.lit("size").alias("axis"), F.xxhash64("l.clip", "l.kind", "l.block", "r.block").alias("deal"))
    cells = packed(p.where("size is not null"), ["clip", "size"], ["kind", "id"], F.struct("kind", "id")).select("clip", "size", "block", "items")
    kinds = F.array_distinct(F.col("items.kind"))
    ids = lambda k: F.transform(F.filter("items", lambda t: t["kind"].eqNullSafe(k)), lambda t: t["id"])
    cells = cells.select("clip", "size", "block", F.transform(kinds, lambda k: F.struct(k.alias("kind"), ids(k).alias("ids"))).alias("items"))
    l, r = cells.alias("l"), cells.alias("r")
    one = F.col("n.size") == F.col("n.other")
    by_size = near.join(l, (F.col("n.clip") == F.col("l.clip")) & (F.col("n.size") == F.col("l.size")))
    by_size = by_size.join(r, (F.col("n.clip") == F.col("r.clip")) & (F.col("n.other") == F.col("r.size")) & (~one | (F.col("l.block") <= F.col("r.block"))))
    by_size = by_size.select(F.col("l.items").alias("x"), F.col("r.items").alias("y"), (one & (F.col("l.block") == F.col("r.block"))).alias("own"), F.when(one, "type").otherwise("trade").alias("axis"), F.xxhash64("l.clip", "l.size", "r.size", "l.block", "r.block").alias("deal"))

    met = by_kind.union(by_size).repartition(tasks, "deal")
    met = met.select("own", "axis", "y", F.explode("x").alias("x")).select("own", "axis", "x", F.explode("y").alias("y"))
    met = met.where(~F.coalesce(F.col("x.kind") == F.col("y.kind"), F.lit(False)))
    met = met.select("own", "axis", F.col("y.ids").alias("y"), F.explode("x.ids").alias("x")).select("own", "axis", "x", F.explode("y").alias("y"))
    met = met.where((F.col("x") < F.col("y")) | (~F.col("own") & (F.col("x") > F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "axis")


def near_sizes(renditions: DataFrame, clip: str, size: str, tolerance: float) -> DataFrame:
    """(clip, size, other): the distinct sizes of a clip that match, equal ones included.

    Positive sizes within the tolerance lie in the same or the next of buckets that grow by it; others match only themselves.
    """
    sizes = renditions.select(clip, size).where(F.col(clip).isNotNull() & F.col(size).isNotNull()).distinct()
    bucket = F.when(F.col(size) > 0, F.floor(F.log(F.col(size).cast("double")) / (-math.log1p(-tolerance) * (1 + 1e-9))).cast("long"))
    sizes = sizes.withColumn("_bucket", bucket)
    others = sizes.where("_bucket is not null").select(F.col(clip).alias("_clip"), F.col(size).alias("other"), F.explode(F.array(*(F.col("_bucket") + k for k in (-1, 0, 1)))).alias("_near"))
    large, small = F.greatest(size, "other"), F.least(size, "other")
    near = sizes.join(others, (F.col(clip) == F.col("_clip")) & (F.col("_bucket") == F.col("_near"))).where((F.col(size) != F.col("other")) & (large - small <= large * tolerance))
    return near.select(clip, size, "other").union(sizes.select(clip, size, F.col(size).alias("other")))


def quota(pairs: DataFrame, axis: str, margin: str, each: int, order: list[str]) -> DataFrame:
    """Of each axis so many pairs, one from each equal share of its margins."""
    tiles = pairs.withColumn("share", F.ntile(each).over(Window.partitionBy(axis).orderBy(margin, *order)) - 1)
    rest = [c for c in pairs.columns if c not in (axis, *order)]
    best = tiles.groupBy(axis, "share").agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(axis, "share", *(F.col(f"b.{c}") for c in [*order, *rest]))


def blinded(pairs: list, seed: int, repeats: int, gap: int) -> list[dict]:
    """A seeded order with swapped sides; some come again, swapped anew, at least `gap` later."""
    rng = random.Random(seed)
    order = list(pairs)
    rng.shuffle(order)
    out = [{"question": k, "pair": p, "swapped": rng.random() < 0.5, "repeat": False} for k, p in enumerate(order)]
    for first in [dict(q) for q in out[: max(0, min(repeats, len(out)))]]:
        place = next(k for k, q in enumerate(out) if q["question"] == first["question"] and not q["repeat"])
        out.insert(rng.randint(min(place + gap, len(out)), len(out)), first | {"repeat": True, "swapped": rng.random() < 0.5})
    return out


def report(judgments: DataFrame, metric: str, axis: str = "axis") -> DataFrame:
    """Per axis and overall: answered, decided, those the metric's sign confirms, margins by outcome.

    heard is the signed strength of the verdict, metric the signed difference of distances (positive: a is nearer).
    """
    decided = F.col("heard") != 0
    hit = decided & (F.signum("heard") == F.signum(metric))
    size = F.abs(F.col(metric))
    return judgments.rollup(axis).agg(
        F.count("*").alias("answered"), F.count_if(decided).alias("decided"), F.count_if(hit).alias("matched"),
        (F.count_if(hit) / F.nullif(F.count_if(decided), F.lit(0))).alias("confirmed"),
        F.median(F.when(decided, size)).alias("decided_margin"), F.median(F.when(~decided, size)).alias("tied_margin"))
