"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source is one stream of words: its documents in a seeded order, laid end to end and cut into equal blocks (the
last one also takes the remainder). Seats, one for each block to emit, go to sources by the highest quotients
target / (2 k + 1), up to `max_repeat` seats a block. A source's seats go to its shards of blocks (block number modulo
`MIX_SHARDS`) by the same rule with the shards' block counts as votes, which gives an integer quota for each source
and shard. In a shard every block is emitted quota div blocks times, and a seeded permutation (steps of a golden
section from a seeded start, so that the picked lie apart) picks those emitted once more. A document takes the words of its blocks, times their emissions.

The block length of a source is the largest power of two of which `PRECISION` blocks fit into its target (1 to
MAX_BLOCK words; longer where a source would have more than 2^MOST_BLOCKS blocks), so every source comes within a few
parts of PRECISION of its target, and a tiny source has short blocks without making those of others short. Sources with
the same block length compete for seats of that length: equal-token blocks go by highest quotients among them.

The stream positions are prefix sums on two levels: a source's documents are dealt to 4096 hash ranges, whose totals
give offsets, and each range is summed by itself; no source, however large, is sorted in one task. The driver sees the
totals of the sources only.

Highest quotients are found without walking seats one by one: a source's seats for a divisor d are the number of its
quotients of at least 1/d, and d is bisected; the last few seats are dealt in order.

Defined results: null texts have size 0; null sources are one source, last in order; a source of no words has target
0; repeated rows are taken each for itself, in the order of
their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateloom.session import materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_REPEAT = 2
PRECISION = 512
MAX_BLOCK = 1024
MOST_BLOCKS = 33
MIX_SHARDS = 8
RANGE_BITS = 12
SEED = 20_240_501
GOLDEN = 0.6180339887498949
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def waterfill(sizes: list[int], weights: list[float], budget: float, repeat: float = MAX_REPEAT) -> list[float]:
    """Shares of the budget by weight; what goes beyond repeat x size goes to the others by weight, until none is above."""
    targets = [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes)) if sizes[k] > 0]
    while open_ and budget > 0:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if budget * weights[k] / weight >= repeat * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = budget * weights[k] / weight
            break
        for k in over:
            targets[k] = float(repeat * sizes[k])
        budget -= sum(targets[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return targets


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), at most caps[i] each; ties go to the first."""

    def at(level: float) -> list[int]:  # seats whose quotient is above the level
        return [min(c, max(0, math.ceil((v / level - 1) / 2))) for v, c in zip(votes, caps, strict=True)]

    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    if seats <= 0:
        return [0] * len(votes)
    high = max(votes) * 2
    low = high
    while sum(at(low)) < seats:
        high, low = low, low / 2
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if sum(at(middle)) <= seats:
            high = middle
        else:
            low = middle
    given = at(high)
    heap = [(-v / (2 * g + 1), k) for k, (v, g, c) in enumerate(zip(votes, given, caps, strict=True)) if v > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, k = heapq.heappop(heap)
        given[k] += 1
        if given[k] < caps[k]:
            heapq.heappush(heap, (-votes[k] / (2 * given[k] + 1), k))
    return given


def block_length(target: float, size: int, precision: int = PRECISION) -> int:
    """The largest power of two of which so many fit into the target, within its bounds."""
    longest = max(MAX_BLOCK, 1 << max(0, size.bit_length() - MOST_BLOCKS))
    return min(longest, 1 << max(0, int(target // precision).bit_length() - 1))


def plan(totals: list[tuple[str | None, int]], *, precision: int = PRECISION, shards: int = MIX_SHARDS, seed: int = SEED) -> list[dict]:
    """For each source: target, block length, and per shard its blocks, quota and permutation. totals: (source, words)."""
    totals = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [s for _, s in totals]
    targets = waterfill(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))], BUDGET_SHARE * sum(sizes))
    lengths = [block_length(t, s, precision) for t, s in zip(targets, sizes, strict=True)]
    blocks = [max(1, s // length) if s else 0 for s, length in zip(sizes, lengths, strict=True)]
    votes = [t * b / s if s else 0.0 for t, b, s in zip(targets, blocks, sizes, strict=True)]
    quotas = [0] * len(sizes)
    for length in sorted(set(lengths)):
        these = [k for k in range(len(sizes)) if lengths[k] == length]
        given = sainte_lague([votes[k] for k in these], round(sum(votes[k] for k in these)), [MAX_REPEAT * blocks[k] for k in these])
        for k, seats in zip(these, given, strict=True):
            quotas[k] = seats
    out = []
    for k, ((source, size), target, length, n, quota) in enumerate(zip(totals, targets, lengths, blocks, quotas, strict=True)):
        here = [n // shards + (j < n % shards) for j in range(shards)]
        seats = sainte_lague([float(h) for h in here], quota, [MAX_REPEAT * h for h in here])
        steps, shifts = [], []
        for j, h in enumerate(here):
            step = round(max(h, 1) * GOLDEN)
            while math.gcd(step, max(h, 1)) != 1:
                step += 1
            steps.append(step % max(h, 1))
            shifts.append((seed * 2_654_435_761 + 7_919 * (k * shards + j)) % max(h, 1))
        out.append({"source": source, "source_size": size, "target": target, "block": length, "n_blocks": n, "here": here, "seats": seats, "step": steps, "shift": shifts})
    return out


PLAN_SCHEMA = ("source string, source_size long, target double, block long, n_blocks long, here array<long>, seats array<long>, step array<long>, shift array<long>")


def copies(block: Column, shards: int) -> Column:
    """How often a block is emitted, from the columns of the plan."""
    j = F.pmod(block, F.lit(shards)).cast("int")
    here, seats = F.get("here", j), F.get("seats", j)
    place = F.pmod(F.get("step", j) * F.floor(block / F.lit(shards)) + F.get("shift", j), here)
    return F.floor(seats / here) + (place < F.pmod(seats, here)).cast("long")


def positions(rows: DataFrame, seed: int) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """rows (source, size, order columns) with `begin`, the place in the source's stream, and the sources' totals."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = materialize(rows.withColumn("h", h).withColumn("range", F.shiftrightunsigned(h, 64 - RANGE_BITS).cast("int")), "mix_sizes")
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))), "mix_ranges")
    totals = [(r[0], int(r[1])) for r in parts.groupBy("source").agg(F.sum("words")).collect()]
    here = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(here)).alias("r").join(
        parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range")))
    return summed.select("r.*", (F.col("p.offset") + F.col("r.upto") - F.col("r.size")).alias("begin")).drop("range", "upto", "text_key"), totals


def mixed(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False,
          precision: int = PRECISION, shards: int = MIX_SHARDS, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, spans (from word, to word, copies), taken.

    carry: the document's own columns come along as one struct, `row`, whatever their names are.
    """
    spark = documents.sparkSession
    row = [F.struct("*").alias("row")] if carry else []
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *row, F.xxhash64(F.col(text)).alias("text_key"),
                            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    placed, totals = positions(rows, seed)
    quotas = spark.createDataFrame(plan(totals, precision=precision, shards=shards, seed=seed), PLAN_SCHEMA)
    if len(totals) <= BROADCAST_SOURCES:  # else a join by source
        quotas = F.broadcast(quotas)
    joined = placed.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).drop(F.col("q.source"))
    last = F.col("n_blocks") - 1
    first_block, last_block = (F.least(F.floor(x / F.col("block")), last) for x in (F.col("begin"), F.col("begin") + F.col("size") - 1))

    def span(b: Column) -> Column:
        start = F.greatest(b * F.col("block"), F.col("begin"))
        stop = F.least(F.when(b < last, (b + 1) * F.col("block")).otherwise(F.col("source_size")), F.col("begin") + F.col("size"))
        return F.struct((start - F.col("begin")).alias("a"), (stop - F.col("begin")).alias("b"), copies(b, shards).alias("n"))

    spans = F.when(F.col("size") > 0, F.transform(F.sequence(first_block, last_block), span)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint,n:bigint>>"))
    joined = joined.withColumn("spans", spans)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]) * s["n"])
    return joined.select("doc_id", "source", *(["row"] if carry else []), "size", "source_size", "target", "spans", taken.alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def cut_words(text: str, spans: list) -> list[str]:
    """The text of the spans emitted at least once, twice, ...: one text for each pass, neighbours kept together."""
    words = [m.span() for m in re.finditer(WORD, text)]
    out = []
    for least in range(1, MAX_REPEAT + 1):
        runs: list[list[int]] = []
        for s in spans:
            if s["n"] >= least:
                if runs and runs[-1][1] == s["a"]:
                    runs[-1][1] = s["b"]
                else:
                    runs.append([s["a"], s["b"]])
        if runs == [[0, len(words)]]:
            out.append(text)
        elif runs:
            out.append("\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def emitted(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_words(t, s) if t is not None else [] for t, s in zip(text, spans, strict=True)])
