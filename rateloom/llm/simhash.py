"""SimHash near-duplicates: all pairs of fingerprints within a Hamming radius, found in a vantage-point tree.

A vantage-point tree over a bounded sample of the distinct fingerprints (2^20 of them, 8 MB, at most; `POINTS` for each
leaf) splits the Hamming space into leaves of about `leaf_size`, in a task each: a node sends a fingerprint inward if its distance to the vantage point is at most the
node's radius, outward otherwise. Every distinct fingerprint has one home leaf. By the triangle bound |d(v, x) -
d(v, y)| <= d(x, y), a pair within `bits` of each other can lie on different sides only if the inner one is within
`bits` of the boundary; such a fingerprint visits the other side as well, and a visitor goes on into every branch
that the bound can't rule out. Each leaf then holds, for each of its home fingerprints, all partners there are, and
pairs are exact. A leaf of more than `LOCAL_LEAF` fingerprints is split again by a tree of its own points in the same
way, so its work stays below its square; that also holds beyond 2^16 leaves, from where on leaves grow with the input.
Fingerprints visit more leaves the more there are (the README has measured figures), which is the price of the method on
fingerprints that are spread at random. Leaves emit no pairs but a spanning star for each component they see (a breadth-first search that
drops a fingerprint from the search once reached), so a leaf full of near copies costs about its size, not its square.

Copies with a Jaccard similarity of 0.8 or more over sets of five-word shingles (`similar`) are found by bands of minimum
hashes: two texts share a bucket if all `ROWS` minima of one of `BANDS` bands agree, which at a similarity of 0.8 happens
for all but 3 pairs in a million, whatever the kind of edit. Buckets with the same members are kept once. Within a bucket
the shingle sets themselves are compared, so only texts that are alike by four fifths are linked; a breadth-first search
gives a spanning star for each component. A bucket of more than `leaf_size` texts is cut into chunks, and each two chunks
are compared in a block of their own.

Stars of different leaves meet in shared fingerprints; alternating large-star and small-star steps contract them until
nothing changes. Exact copies collapse into one fingerprint before anything is compared. Tables written to the shared
folder cut the lineage of each step.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; repeated rows share
their component; null ids take part but never name a component unless it has no other id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.llm.arrow import lower_space_words, map_columns, struct
from rateloom.session import materialize, table

SHINGLE = 3
BITS = 3
LEAF_SIZE = 4096
MAX_SAMPLE = 1 << 20
POINTS = 16
LOCAL_LEAF = 1024
SEED = 42
BROADCAST_NODES = 1_000_000
BROADCAST_HEADS = 131_072
BANDS, ROWS = 32, 5
#: Two sets are alike if their Jaccard similarity is at least 4 / 5; compared in integers.
SIMILAR = (4, 5)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed integer."""
    words = lower_space_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = struct(f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fp long")
    return map_columns(base, lambda ids, texts: (ids, [fingerprint(t, shingle) for t in texts]), fields)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def build_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inner child, outer child); a child below zero is the leaf -1 - child."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int, int, int]] = []
    made = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal made
        split = None
        if want > 1 and len(points) > 1:
            for vantage in points[rng.integers(len(points), size=4)]:
                d = distance(points, vantage).astype(np.int64)
                radius = int(np.sort(d)[(len(d) - 1) // 2])
                inside = d <= radius
                if inside.all():
                    radius -= 1
                    inside = d <= radius
                if not inside.any() or radius < 0:
                    continue
                near = np.abs(d - radius - 0.5) <= BITS  # fewer of these mean fewer visits
                uneven = abs(int(inside.sum()) * 2 - len(d)) / len(d)
                cost = near.mean() + uneven
                if split is None or cost < split[0]:
                    split = (cost, int(vantage), radius, inside)
        if split is None:
            made += 1
            return -made
        _, vantage, radius, inside = split
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        share = min(max(round(want * float(inside.mean())), 1), want - 1)
        inner, outer = grow(points[inside], share), grow(points[~inside], want - share)
        nodes[at] = (vantage, radius, inner, outer)
        return at

    grow(sample, leaves)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves, places in fps and whether the leaf is home, for each home and visit."""
    out: list[tuple[int, np.ndarray, bool]] = []
    todo = [(0 if nodes else -1, np.arange(len(fps)), True)]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((-1 - at, rows, home))
            continue
        vantage, radius, inner, outer = nodes[at]
        d = distance(fps[rows], np.int64(vantage)).astype(np.int64)
        inside = d <= radius
        if home:
            todo += [(inner, rows[inside], True), (outer, rows[~inside], True), (outer, rows[inside & (d + bits > radius)], False)]
        else:
            todo += [(inner, rows[d - bits <= radius], False), (outer, rows[d + bits > radius], False)]
    return (
        np.concatenate([np.full(len(r), leaf, np.int32) for leaf, r, _ in out] or [np.empty(0, np.int32)]),
        np.concatenate([r for _, r, _ in out] or [np.empty(0, np.int64)]),
        np.concatenate([np.full(len(r), home) for _, r, home in out] or [np.empty(0, bool)]),
    )


def leaf_stars(node: np.ndarray, fps: np.ndarray, home: np.ndarray, sketch: np.ndarray, bits: int, sketch_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect whatever the leaf's homes reach in the leaf. sketch: columns to compare besides."""
    order = np.argsort(~home, kind="stable")
    node, fps, sketch, n_home = node[order], fps[order], sketch[order], int(home.sum())
    left = np.arange(len(fps))  # not reached yet; homes come first
    members, roots = [], []
    while len(left) and left[0] < n_home:
        seed = left[0]
        left = left[1:]
        frontier = [seed]
        while frontier:
            at = frontier.pop()
            near = distance(fps[left], fps[at]) <= bits
            if near.any() and sketch.shape[1]:
                close = np.flatnonzero(near)
                near[close] = distance(sketch[left[close]], sketch[at]).sum(axis=1, dtype=np.int64) <= sketch_bits
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found.tolist())
                members.append(node[found])
                roots.append(np.full(len(found), node[seed]))
    empty = np.empty(0, np.int64)
    return np.concatenate(members or [empty]), np.concatenate(roots or [empty])


def local_stars(node: np.ndarray, fps: np.ndarray, home: np.ndarray, sketch: np.ndarray, bits: int, sketch_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a leaf, by a tree of its own where it is large.

    In the local leaves all that are at home there search, for a pair meets only where its outer one is at home.
    """
    if len(node) <= LOCAL_LEAF:
        return leaf_stars(node, fps, home, sketch, bits, sketch_bits)
    leaf, row, inside = route(build_tree(np.unique(fps), -(-len(node) // LOCAL_LEAF)), fps, bits)
    order = np.argsort(leaf, kind="stable")
    ends = np.flatnonzero(np.diff(leaf[order], append=-1)) + 1
    out = [leaf_stars(node[row[at]], fps[row[at]], inside[at], sketch[row[at]], bits, sketch_bits)
           for at in np.split(order, ends[:-1]) if home[row[at]].any()]
    empty = np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out] or [empty]), np.concatenate([b for _, b in out] or [empty])


def near_edges(items: DataFrame, *, bits: int = BITS, sketch_bits: int = 0, leaf_size: int = LEAF_SIZE, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Edges (a, b) among items (node, fps: a fingerprint for each tree, sketch) whose components are those of all links."""
    spark = items.sparkSession
    n = items.count()
    leaves = max(1, min(-(-n // leaf_size), max_sample // POINTS))
    share = min(1.0, POINTS * leaves / max(n, 1))
    # a share of the hash space, not of the rows: the same fingerprints whatever the partitions
    picked = items.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("fps")
    sample = np.array([r[0] for r in picked.collect()], np.int64) if leaves > 1 else np.empty((0, 0), np.int64)
    forest = [build_tree(np.unique(sample[:, k]), leaves) for k in range(sample.shape[1])] if len(sample) else None
    held = spark.sparkContext.broadcast(forest)  # at most max_sample / 64 nodes a tree

    def send(nodes, fps, sketches):
        fps, nodes, sketch = np.array(fps, np.int64), np.array(nodes, np.int64), np.array(sketches, np.int64)
        if not len(nodes):
            return [], [], [], [], [], []
        out = []
        for k in range(fps.shape[1]):
            leaf, row, home = route(held.value[k] if held.value else [], fps[:, k], bits)
            out.append((np.full(len(row), k, np.int32), leaf, nodes[row], fps[row, k], home, row))
        tree, leaf, node, fp, home, row = (np.concatenate(c) for c in zip(*out, strict=True))
        return tree, leaf, node, fp, home, list(sketch[row])

    def link(part: pd.DataFrame) -> pd.DataFrame:
        sketch = np.array(part["sketch"].tolist(), np.int64).reshape(len(part), -1)
        a, b = local_stars(part["node"].to_numpy(np.int64), part["fp"].to_numpy(np.int64), part["home"].to_numpy(bool), sketch, bits, sketch_bits)
        return pd.DataFrame({"a": a, "b": b})

    routed = map_columns(items.select("node", "fps", "sketch"), send, "tree int, leaf int, node long, fp long, home boolean, sketch array<long>")
    return routed.groupBy("tree", "leaf").applyInPandas(link, "a long, b long")


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (node, root): the root is the smallest node of the component. Large-star and small-star until nothing changes."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        # large star: greater neighbours go to the smallest of the neighbourhood
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(edges, "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")


def rooted(items: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, root, component_id) from items (node, first_id) and stars (node, root)."""
    named = items.select("node", "first_id").join(stars, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "rooted")
    smallest = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    return materialize(named.join(smallest, "root").select("node", "root", "component_id"), "components")


def components(prints: DataFrame, *, bits: int = BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of prints(doc_id, fp): the smallest doc_id reachable."""
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct").withColumnRenamed("fp", "node")
    items = firsts.withColumns({"fps": F.array("node"), "sketch": F.array().cast("array<long>")})
    stars = materialize(contracted(near_edges(items, bits=bits, leaf_size=leaf_size)), "stars")
    return rooted(firsts, stars).withColumnRenamed("node", "fp")


def salts(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


SALTS = salts(BANDS * ROWS, 1)  # fixed by their seeds
BAND_SALTS = salts(BANDS, 2)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; texts without words share one of their own."""
    words = lower_space_words(text)
    grams = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def band_keys(text: str | None) -> np.ndarray:
    """A 64-bit key for each band of minimum hashes, as signed integers."""
    hashes = shingles(text)
    least = np.full(len(SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, mixed_bits(hashes[at : at + (1 << 10), None] * SALTS).min(axis=0))
    key = BAND_SALTS.copy()
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed_bits((key ^ row) * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def exact_stars(node: np.ndarray, sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (node, root) that connect whatever is linked by sets alike by four fifths; every pair is compared exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(values), np.int64)
    left = np.arange(len(node))
    members, roots = [], []
    while len(left):
        seed = left[0]
        left = left[1:]
        frontier = [seed]
        while frontier and len(left):
            at = frontier.pop()
            own = ids[starts[at] : ends[at]]
            mark[own] = 1
            shared = np.add.reduceat(mark[ids], starts)[left]
            mark[own] = 0
            near = shared * sum(SIMILAR) >= SIMILAR[0] * (sizes[left] + sizes[at])
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found.tolist())
                members.append(node[found])
                roots.append(np.full(len(found), node[seed]))
    return members, roots


def similar_edges(items: DataFrame, texts: DataFrame, *, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """Edges (a, b) among items (node, bands) whose components are those of all links; texts (node, text) may repeat."""
    placed = items.select(F.explode("bands").alias("band"), "node")
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = placed.groupBy("band").agg(F.count("*").alias("n"), *members).where("n > 1")
    buckets = materialize(shared.groupBy("n", "x1", "x2").agg(F.min("band").alias("band")).select("band", "n"), "buckets")
    cuts = F.when(F.col("n") <= leaf_size, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / leaf_size)).cast("long")
    inside = placed.join(buckets, "band").select("band", "node", cuts.alias("cuts"), F.pmod(F.xxhash64("node"), cuts).alias("chunk"))
    others = F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), F.col("chunk"))
    inside = inside.withColumn("other", F.explode(F.when(F.col("cuts") == 1, F.array("chunk")).otherwise(others)))
    block = F.xxhash64("band", F.least("chunk", "other"), F.greatest("chunk", "other"))
    inside = materialize(inside.select("node", block.alias("block")), "inside")
    n_inside = inside.count()
    leaves = max(1, n_inside // 1024)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        node, sets = part["node"].to_numpy(np.int64), part["set"].tolist()
        found = [exact_stars(node[at], [sets[k] for k in at]) for at in part.groupby("block").indices.values() if len(at) > 1]
        a, b = ([x for f in found for x in f[side]] for side in (0, 1))
        empty = np.empty(0, np.int64)
        return pd.DataFrame({"a": np.concatenate(a or [empty]), "b": np.concatenate(b or [empty])})

    # copies are combined on the map side, before the join or, where the nodes are few, after a join without a shuffle
    nodes = inside.select("node").distinct()
    if n_inside <= BROADCAST_NODES:
        once = texts.join(F.broadcast(nodes), "node", "left_semi").dropDuplicates(["node"])
    else:
        once = texts.dropDuplicates(["node"]).join(nodes, "node", "left_semi")
    once = once.select("node", "text")
    sets = map_columns(once, lambda nodes, texts: (nodes, [shingles(t).view(np.int64) for t in texts]), "node long, set array<long>")
    joined = inside.join(materialize(sets, "sets"), "node").withColumn("leaf", F.pmod("block", F.lit(leaves)))
    return joined.groupBy("leaf").applyInPandas(link, "a long, b long")


def fingerprint_edges(items: DataFrame, *, bits: int = BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """Edges (a, b) among items (node, fp) whose components are those of all fingerprints within the radius."""
    heads = materialize(items.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
    points = heads.select(F.col("head").alias("node"), F.array("fp").alias("fps"), F.array().cast("array<long>").alias("sketch"))
    repeated = heads.where("n > 1").select("fp", "head")
    few = repeated.count() <= BROADCAST_HEADS  # else a fingerprint of many texts is one task of the join, unless Spark splits it
    copies = items.join(F.broadcast(repeated) if few else repeated, "fp").where("node <> head").select("node", "head")
    return near_edges(points, bits=bits, leaf_size=leaf_size).union(copies)


def similar(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", leaf_size: int = LEAF_SIZE, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) of the documents, node a 64-bit hash of the text, and (node, component_id).

    bits: texts whose fingerprints differ in so many bits at most are linked too, as `near_duplicates` links them.
    """
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = base.select("doc_id", text_node(F.col("text")).alias("node"), "text")
    prints = (lambda texts: [None] * len(texts)) if bits is None else (lambda texts: [fingerprint(t) for t in texts])
    made = map_columns(rows, lambda ids, nodes, texts: (ids, nodes, [band_keys(t) for t in texts], prints(texts)), struct(f"doc_id {kind}, node long, bands array<long>, fp long"))
    made = materialize(made, "band_keys")
    items = materialize(made.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "items")
    edges = similar_edges(items, rows.select("node", "text"), leaf_size=leaf_size)
    if bits is not None:
        edges = edges.union(fingerprint_edges(items.select("node", "fp"), bits=bits, leaf_size=leaf_size))
    stars = materialize(contracted(edges), "stars")
    return made.select("doc_id", "node"), rooted(items, stars)


def text_node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies, by fingerprints or shingles: of each component the row with the smallest id (then text) stays."""
    rows, found = similar(documents, doc_id=doc_id, text=text, bits=BITS)
    keep = rows.join(found, "node").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    keep = materialize(keep.select("first.doc_id", "first.node"), "kept").alias("k")
    mine = lambda d: F.col(f"d.{d}").eqNullSafe(F.col("k.doc_id"))
    stay = documents.alias("d").join(keep, mine(doc_id) & (text_node(F.col(f"d.{text}")) == F.col("k.node")), "left_semi")
    repeated = rows.alias("d").join(keep, mine("doc_id") & (F.col("d.node") == F.col("k.node")), "left_semi")
    if repeated.groupBy("doc_id", "node").count().where("count > 1").limit(1).count():  # rows that say the same
        one = F.struct(F.struct("*").alias("row"), F.col(doc_id).alias("id"), text_node(F.col(text)).alias("node"))
        picked = stay.select(one.alias("d")).groupBy("d.id", "d.node").agg(F.min_by("d.row", F.to_json("d.row")).alias("row"))
        return picked.select(*(F.col("row").getField(c).alias(c) for c in documents.columns))
    return stay


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """A row per document: doc_id, fp, component_id."""
    prints = materialize(fingerprints(documents, doc_id=doc_id, text=text, shingle=shingle), "prints")
    return prints.join(components(prints, bits=bits, leaf_size=leaf_size), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
