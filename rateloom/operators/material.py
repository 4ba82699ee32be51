"""Material against recordings: tasks, routing, sweeps, pattern packing, sources and their unions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateloom.operators import relational as R


def tasks(material: DataFrame, recordings: DataFrame, key: str = "pitch") -> DataFrame:
    """Material with its recordings by key; material that none answers fails the job when read."""
    found = material.join(recordings, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no recording for {key} "), F.col(key).cast("string")))
    return found.withColumn("file", F.when(F.col("file").isNull(), missing).otherwise(F.col("file")))


def note_records(events: DataFrame, recordings: DataFrame, key: str = "pitch", count: str = "count") -> DataFrame:
    """Events expanded by their counts, each routed to the nearest recorded key."""
    notes = events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))
    return R.nearest_join(notes, recordings.groupBy(key).agg(F.min(key).alias("_k")), [], key, key, "_k").drop("nearest_value")


def covered_routing(keys: DataFrame, low: int, high: int, by: list[str], key: str = "pitch") -> DataFrame:
    """Every key of the keyboard with the nearest recorded one of its group."""
    board = keys.select(*by).distinct().withColumn("key", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return R.nearest_join(board, keys.groupBy(*by, key).agg(F.min(key).alias("_k")), by, "key", key, "_k").drop("nearest_value")


def sweep(tasks_: DataFrame, rates: list[int], depths: list[int], own_rate: str) -> DataFrame:
    """Tasks crossed with their encodings: the ladder's rates below their own and their own, by depth."""
    ladder = F.array_sort(F.array_distinct(F.concat(F.filter(F.array(*map(F.lit, rates)), lambda r: r < F.col(own_rate)), F.array(F.col(own_rate)))))
    return tasks_.withColumn("rate", F.explode(F.reverse(ladder))).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))


def offered_rates(settled: int, ladder: list[int], headroom: int) -> list[int]:
    """The settled rate and the next rungs above."""
    return [settled, *[r for r in sorted(ladder) if r > settled][:headroom]]


def packed(events: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """Ordered events dealt to patterns: one that would overflow opens the next. Sequential inside a group."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        number, used, out = 0, 0, []
        for s in pdf[size]:
            if used and used + s > capacity:
                number, used = number + 1, 0
            out.append((number, used))
            used += s
        return pdf.assign(pattern=[p for p, _ in out], row=[r for _, r in out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields) + ", pattern int, row long"
    return events.groupBy(group).applyInPandas(deal, schema)


def gathered(sources: list[DataFrame]) -> DataFrame:
    """All sources under one another."""
    if not sources:
        raise ValueError("no sources")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def combined_options(segments: list[DataFrame], keys: list[int]) -> DataFrame:
    """Options of segments side by side on one axis: each segment's starts and stops move behind the keys before it."""
    out, offset = [], 0
    for options, n in zip(segments, keys, strict=True):
        out.append(options.withColumns({"start": F.col("start") + offset, "stop": F.col("stop") + offset}))
        offset += n
    return gathered(out)


def key_coverage(routed: DataFrame, instrument: str, key: str, low: int, high: int) -> DataFrame:
    """One row: keys of the keyboard, those any instrument answers, and those the least covered instrument answers."""
    inside = F.when(F.col(key).between(low, high), F.col(key))
    answers = routed.where(F.col(instrument).isNotNull()).groupBy(instrument).agg(F.collect_set(inside).alias("keys"))  # no longer than the keyboard
    counts = answers.agg(F.coalesce(F.min(F.size("keys")), F.lit(0)).cast("long").alias("answered"))
    played = routed.agg(F.count_distinct(inside).alias("played"))
    return counts.select(F.lit(high - low + 1).cast("long").alias("numbered"), played.scalar().alias("played"), "answered")
