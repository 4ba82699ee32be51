"""Sharding by minimax contiguous partition: the smallest shard capacity that the ordered atomic groups allow.

Equal texts are one atomic group; groups stand in the order of their texts' SHA-256, which spreads any input evenly.
A group larger than an equal share of what is left gets a shard of its own (the largest first, at most one a shard).
Over the others, a binary search finds the smallest capacity at which greedy filling needs no more than the shards
left, and the groups are cut there.

The search never brings the groups to the driver. It works on nodes, each a range of digests with its total size:
first the 256 ranges of two hexadecimal digits, then, only where a cut could still fall, ranges of two digits more,
until every cut falls between single groups. A node far from any cut stays whole, for no greedy cut of a capacity up
to the best one known lies in it. So each level reads a few thousand rows at most, and the result is the exact
minimum over the groups. The cuts are digests: the shard of a row is an expression of its own text, with no join.

Slots are numbered without a window over a whole shard: rows are dealt to `SLOT_PARTS` parts of each shard by hash,
the parts' counts give offsets, and each part is numbered by itself.

Defined results: a null text has size 1, checksum 0 and the group of the empty text; an empty table gives no rows;
repeated rows each get a slot of their own; columns other than the named ones are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rateloom.session import materialize, table

SHARDS = 8
SLOT_PARTS = 512
DIGITS = 64


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def greedy_cuts(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Starts of the shards after the first, each shard filled as far as the capacity goes; None if the shards don't do."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(ends, ends[at] + capacity) - 1
        if at == len(sizes):
            return cuts
        cuts.append(at)
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest feasible capacity."""
    low, high = max([0, -(-sum(sizes) // shards), *sizes]), max(sum(sizes), 0)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def open_ranges(total: int, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Where the i-th cut of a feasible greedy filling of at most this capacity can lie: the rest must fit as well."""
    return [(max(0, total - (shards - i) * capacity), min(total, i * capacity)) for i in range(1, shards)]


def contiguous_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digest prefixes at which shards after the first begin, and the capacity. groups: digest, size, one row a group."""

    def nodes_of(digits: int, within: list[str] | None) -> list[list]:
        part = groups
        if within is not None:
            part = part.where(F.substring("digest", 1, len(within[0])).isin(within))
        rows = part.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return sorted([r["prefix"], int(r["size"]), int(r["n"])] for r in rows)

    nodes = nodes_of(2, None)
    while True:
        sizes = [n[1] for n in nodes]
        total, capacity = sum(sizes), smallest_capacity(sizes, shards)
        spans = open_ranges(total, capacity, shards)
        to_open, at = [], 0
        for prefix, size, n in nodes:
            if n > 1 and any(low < at + size and at < high for low, high in spans):
                to_open.append(prefix)
            at += size
        if not to_open:
            cuts = greedy_cuts(sizes, capacity, shards) or []
            return [nodes[c][0] for c in cuts], capacity
        shortest = min(map(len, to_open))
        now = [p for p in to_open if len(p) == shortest]
        finer = nodes_of(shortest + 2, now)
        gone = set(now)
        nodes = sorted([n for n in nodes if n[0] not in gone] + finer)


def shard_column(groups: DataFrame, shards: int) -> Column:
    """The shard of a row as an expression of its column `digest`. groups: digest, size."""
    left, total, own = shards, groups.agg(F.sum("size")).first()[0] or 0, []
    for row in groups.orderBy(F.desc("size"), "digest").limit(shards - 1).collect():
        if left > 1 and row["size"] * left > total:
            own.append(row["digest"])
            total -= row["size"]
            left -= 1
    rest = groups.where(~F.col("digest").isin(own)) if own else groups
    cuts, _ = contiguous_cuts(rest, left)
    shard = F.lit(len(own))
    for cut in cuts:
        shard = shard + (F.col("digest") >= F.lit(cut)).cast("int")
    for k, d in enumerate(own):
        shard = F.when(F.col("digest") == F.lit(d), F.lit(k)).otherwise(shard)
    return shard.cast("int")


def numbered(rows: DataFrame, order: list[str], slot_parts: int = SLOT_PARTS) -> DataFrame:
    """Gapless slots from 0 in each shard."""
    parted = materialize(rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(slot_parts)).cast("int")), "sharded")
    counts = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    here = Window.partitionBy("shard", "part").orderBy(*order)
    numbers = parted.withColumn("rank", F.row_number().over(here))
    return numbers.join(offsets, ["shard", "part"]).withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long")).drop("part", "offset", "rank")


def sharded(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot."""
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), byte_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), digest(F.col(text)).alias("digest"),
    )
    rows = materialize(rows, "digests")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    placed = rows.withColumn("shard", shard_column(groups, shards))
    return numbered(placed, ["doc_id", "digest"]).drop("digest")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
