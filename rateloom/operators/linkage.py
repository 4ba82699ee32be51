"""Average linkage of one space without its matrix of distances: nearest clusters by Spark, merges on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.functions import kernels

#: Clusters whose distances are held as a matrix, nearest clusters that a search keeps, rows and columns of a block of distances.
DENSE = 2048
NEAREST = 32
ROWS, COLUMNS = 128, 2048
#: Squared distances from differences, as a share of the rows' squares.
NEAR = 0.01
#: Rows of clusters that meet by size.
FEW = 16
#: Pairs of rows whose differences are taken at once, and pairs of two clusters from which a matrix product pays.
PAIRS, PRODUCT = 1 << 15, 1 << 11
#: Batches of rows that a task searches.
BATCHES = 20

Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Search = Callable[[np.ndarray, np.ndarray, int], Found]


class Space:
    """Rows sorted by cluster, clusters by their rows, and the mean distances of clusters. Rows have weights (copies).

    Clusters of few rows meet in blocks of one size, where the first rows of all come first, then the second ones: sums
    are then sums of whole slices.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray, label: np.ndarray):
        size = np.bincount(label, minlength=len(x))
        self.ids = np.argsort(size, kind="stable")[np.count_nonzero(size == 0) :]
        self.size, self.place = size[self.ids], np.full(len(x), -1)
        self.place[self.ids] = np.arange(len(self.ids))
        order = np.argsort(self.place[label], kind="stable")
        self.x, self.w = x[order], w[order].astype(float)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.weight = np.add.reduceat(self.w, self.start)
        self.square, self.plain = (self.x * self.x).sum(axis=1), bool((self.w == 1).all())
        self.short = {np.float64: (self.x, self.square), np.float32: (self.x.astype(np.float32), self.square.astype(np.float32))}
        self.room = np.empty(0)

    def rows(self, clusters: np.ndarray) -> np.ndarray:
        """Rows of clusters: slices of first rows, second rows and so on, or (clusters of many rows) one after the other."""
        size = self.size[clusters]
        if size[0] <= FEW:
            return (self.start[clusters] + np.arange(size[0])[:, None]).ravel()
        return np.repeat(self.start[clusters] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def add(self, d: np.ndarray, clusters: np.ndarray) -> np.ndarray:
        """Sums over the first axis, whose rows are those of clusters."""
        if self.size[clusters[0]] <= FEW:
            return d.reshape(-1, len(clusters), d.shape[1]).sum(axis=0)
        ends = np.cumsum(self.size[clusters])
        return np.stack([d[e - n : e].sum(axis=0) for e, n in zip(ends, self.size[clusters], strict=True)])

    def distances(self, rows: np.ndarray, columns: np.ndarray, kind: type) -> np.ndarray:
        """Weighted distances; those that a matrix product can't give are taken from differences."""
        x, square = self.short[kind]
        a, b = x[rows], x[columns]
        scale = square[rows][:, None] + square[columns]
        d = a @ b.T
        d *= -2
        d += scale
        scale *= NEAR
        near = d < scale
        if near.any():
            i, j = np.nonzero(near)
            for at in range(0, len(i), PAIRS):
                apart = a[i[at : at + PAIRS]] - b[j[at : at + PAIRS]]
                d[i[at : at + PAIRS], j[at : at + PAIRS]] = (apart * apart).sum(axis=1)
        np.sqrt(d, out=d)
        if not self.plain:
            d *= self.w[rows].astype(kind)[:, None]
            d *= self.w[columns].astype(kind)
        return d

    def sums(self, mine: np.ndarray, others: np.ndarray, kind: type) -> np.ndarray:
        """Sums of the distances of clusters; strips keep the blocks small."""
        rows, columns = self.rows(mine), self.rows(others)
        few = self.size[others[0]] <= FEW
        heads = None if few else np.cumsum(self.size[others]) - self.size[others]
        if len(rows) <= 2 * ROWS and len(columns) <= 2 * COLUMNS:
            d = self.distances(rows, columns, kind)
            d = d.reshape(len(rows), -1, len(others)).sum(axis=1) if few else np.add.reduceat(d, heads, axis=1)
            return self.add(d, mine)
        out = np.zeros((len(mine), len(others)))  # a long cluster
        for r in range(0, len(rows), ROWS):
            of = np.zeros((min(ROWS, len(rows) - r), len(others)))
            for c in range(0, len(columns), COLUMNS):
                part = columns[c : c + COLUMNS]
                whose = np.arange(c, c + len(part)) % len(others) if few else np.searchsorted(heads, np.arange(c, c + len(part)), "right") - 1
                by = np.argsort(whose, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(whose[by]) != 0])
                of[:, whose[by][first]] += np.add.reduceat(self.distances(rows[r : r + ROWS], part[by], kind), first, axis=1)
            whose = np.arange(r, r + len(of)) % len(mine) if self.size[mine[0]] <= FEW else np.searchsorted(np.cumsum(self.size[mine]), np.arange(r, r + len(of)), "right")
            np.add.at(out, whose, of)
        return out

    def means(self, mine: np.ndarray, kind: type, first: int = 0) -> np.ndarray:
        """Mean distances of clusters to all from a first one; infinite to themselves. The next call overwrites them."""
        shape = len(mine), len(self.size)
        if self.room.size < shape[0] * shape[1]:
            self.room = np.empty(shape[0] * shape[1])
        out = self.room[: shape[0] * shape[1]].reshape(shape)
        for others in blocks(self.size[first:], np.arange(first, len(self.size)), COLUMNS):
            out[:, others[0] : others[-1] + 1] = self.sums(mine, others, kind)
        if self.weight[-1] > 1 or not self.plain:
            out[:, first:] /= self.weight[mine][:, None]
            out[:, first:] /= self.weight[first:]
        out[np.arange(len(mine)), mine] = np.inf
        return out

    def exactly(self, cluster: int, others: np.ndarray) -> np.ndarray:
        """Mean distances of a cluster to some others, in ascending order."""
        mine = np.array([cluster])
        total = np.concatenate([self.sums(mine, some, np.float64)[0] for some in blocks(self.size[others], others, COLUMNS)])
        return total / (self.weight[cluster] * self.weight[others])

    def nearest(self, mine: np.ndarray, k: int) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """Of each cluster some k nearest ones, with their distances, and a reach: all others are as far or farther.

        The k are chosen by distances of single precision, and the reach is less than the k-th by more than their error;
        where the nearest one is not within it, by those of double precision.
        """
        n = len(self.size)
        if n - 1 <= k:  # all clusters are searched for, so links to later ones are enough
            for at, d in zip(mine, self.means(mine, np.float64, mine[0]), strict=True):
                who = np.arange(at + 1, n)
                yield self.ids[at], np.inf, self.ids[who], d[who]
            return

        def least(d: np.ndarray) -> np.ndarray:
            low = np.minimum.reduceat(d, np.arange(0, n, max(1, n // (8 * k))))  # the k-th least of these bounds the k-th least of all
            who = np.flatnonzero(d <= np.partition(low, k - 1)[k - 1])
            return np.sort(who[np.argpartition(d[who], k - 1)[:k]])

        error = 2.0**-23 * ((self.x.shape[1] + 4) / NEAR + 2 * COLUMNS + 2 * ROWS)
        close = []
        for at, d in zip(mine, self.means(mine, np.float32), strict=True):
            who = least(d)
            reach, exact = float(d[who].max()) * (1 - error) - 2.0**-21 * np.sqrt(self.square.max()), self.exactly(at, who)
            if exact.min() > reach:
                close.append(at)
            else:
                yield self.ids[at], reach, self.ids[who], exact
        for at in close:
            d = self.means(np.array([at]), np.float64)[0]
            who = least(d)
            yield self.ids[at], float(d[who].max()) * (1 + 1e-12), self.ids[who], d[who]


def blocks(size: np.ndarray, clusters: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Clusters (by ascending size) in blocks of about so many rows, those of few rows in blocks of one size."""
    kind = np.minimum(size, FEW + 1)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        to = min(np.searchsorted(kind, kind[at], "right"), np.searchsorted(total, total[at] - size[at] + rows, "right"))
        to = max(at + 1, int(to))
        yield clusters[at:to]
        at = to


def paired(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(u, v).astype(np.int64) * n + np.maximum(u, v)


class Merging:
    """Clusters, and links between them: a mean distance, or (not exact) a bound below it.

    Clusters without a link are at least the larger of their reaches apart. Both bounds carry over to merged clusters, whose
    distances are weighted means. So a cluster's nearest one is certain where its least link is exact and within its reach.
    As no merge brings another cluster nearer, pairs that are each other's nearest are merged at once.
    """

    def __init__(self, x: np.ndarray, w: np.ndarray):
        n = len(x)
        self.x, self.w, self.label = x, w.astype(float), np.arange(n)
        self.weight, self.reach = self.w.copy(), np.full(n, -np.inf)
        self.u, self.v, self.d, self.exact = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
        self.merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.alive = np.ones(n, bool)

    def learn(self, who: np.ndarray, reach: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        """What a search found: exact links replace bounds."""
        self.reach[who] = reach
        n = len(self.x)
        key = np.r_[paired(u, v, n), paired(self.u, self.v, n)]
        d, exact = np.r_[d, self.d], np.r_[np.ones(len(d), bool), self.exact]
        order = np.lexsort((~exact, key))
        order = order[np.r_[True, np.diff(key[order]) != 0]] if len(key) else order
        self.u, self.v, self.d, self.exact = key[order] // n, key[order] % n, d[order], exact[order]

    def least(self, d: np.ndarray) -> np.ndarray:
        out = np.full(len(self.x), np.inf)
        np.minimum.at(out, self.u, d)
        np.minimum.at(out, self.v, d)
        return out

    def measure(self) -> np.ndarray:
        """Each cluster's least distance, its reach at most. Bounds below it are replaced by distances, the least of each cluster first."""
        best = np.minimum(self.least(np.where(self.exact, self.d, np.inf)), self.reach)
        below = lambda some, d: some[(self.d[some] < d[self.u[some]]) | (self.d[some] < d[self.v[some]])]
        ask = below(np.flatnonzero(~self.exact), best)
        low = np.full(len(best), np.inf)
        for side in (self.u, self.v):
            np.minimum.at(low, side[ask], self.d[ask])
        first = (self.d[ask] <= low[self.u[ask]]) | (self.d[ask] <= low[self.v[ask]])
        for some in (ask[first], ask[~first]):
            some = below(some, best)
            self.settle(some)
            for side in (self.u, self.v):
                np.minimum.at(best, side[some], self.d[some])
        return best

    def settle(self, ask: np.ndarray) -> None:
        """Measures these links."""
        if not len(ask):
            return
        order = np.argsort(self.label, kind="stable")
        sizes = np.bincount(self.label, minlength=len(self.x))
        start = np.cumsum(sizes) - sizes
        a, b = self.u[ask], self.v[ask]
        count = sizes[a] * sizes[b]
        total = np.zeros(len(ask))
        small = np.flatnonzero(count <= PRODUCT)
        cut = np.flatnonzero(np.diff(np.cumsum(count[small]) // PAIRS, prepend=-1)) if len(small) else []
        for i, j in zip(cut, [*cut[1:], len(small)], strict=False):
            some = small[i:j]
            which = np.repeat(np.arange(len(some)), count[some])
            step = np.arange(len(which)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            p = order[start[a[some]][which] + step // sizes[b[some]][which]]
            q = order[start[b[some]][which] + step % sizes[b[some]][which]]
            apart = self.x[p] - self.x[q]
            total[some] = np.bincount(which, np.sqrt(np.einsum("ij,ij->i", apart, apart)) * self.w[p] * self.w[q], len(some))
        for i in np.flatnonzero(count > PRODUCT):
            p, q = (order[start[c] : start[c] + sizes[c]] for c in (a[i], b[i]))
            for at in range(0, len(p), ROWS):
                for to in range(0, len(q), COLUMNS):
                    some, other = p[at : at + ROWS], q[to : to + COLUMNS]
                    total[i] += self.w[some] @ kernels.distances(self.x[some], self.x[other]) @ self.w[other]
        self.d[ask], self.exact[ask] = total / (self.weight[a] * self.weight[b]), True

    def step(self) -> int:
        """Merges all pairs that are certainly each other's nearest; how many."""
        best, n = self.measure(), len(self.x)
        some = np.flatnonzero(self.exact & ((self.d == best[self.u]) | (self.d == best[self.v])))
        mixed = (paired(self.u[some], self.v[some], n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        order = some[np.lexsort((mixed, self.d[some]))]  # ties in no order of the rows, lest one pair at a time merge
        u, v, at = self.u[order], self.v[order], np.arange(len(order))
        rank = np.full(n, len(order))
        for side in (u, v):
            own = self.d[order] == best[side]
            np.minimum.at(rank, side[own], at[own])
        held = order[(rank[u] == at) & (rank[v] == at)]
        if not len(held):
            return 0
        self.join(self.u[held].copy(), self.v[held].copy(), self.d[held].copy())
        return len(held)

    def join(self, u: np.ndarray, v: np.ndarray, height: np.ndarray) -> None:
        n = len(self.x)
        self.merges.append((height, u, v))
        into, other = np.arange(n), np.full(n, -1)
        into[v], other[u] = u, v
        weight, reach = self.weight.copy(), self.reach.copy()
        self.weight[u] += weight[v]
        self.reach[u] = (weight[u] * reach[u] + weight[v] * reach[v]) / self.weight[u]
        self.label, self.alive[v] = into[self.label], False
        a, b = into[self.u], into[self.v]
        touched = ((other[a] >= 0) | (other[b] >= 0)) & (a != b)
        rest = (a != b) & ~touched
        key = paired(a[touched], b[touched], n)
        some, at = np.unique(key, return_inverse=True)
        a, b = some // n, some % n
        floor = np.maximum(reach[self.u[touched]], reach[self.v[touched]])
        mass = weight[self.u[touched]] * weight[self.v[touched]]
        total = np.bincount(at, mass * (self.d[touched] - floor), len(some))
        parts = np.bincount(at, self.exact[touched], len(some))
        for i in (a, other[a]):
            for j in (b, other[b]):
                total += np.where((i >= 0) & (j >= 0), weight[i] * weight[j] * np.maximum(reach[i], reach[j]), 0.0)
        d = total / (self.weight[a] * self.weight[b])
        exact = parts == (1 + (other[a] >= 0)) * (1 + (other[b] >= 0))
        keep = d <= np.maximum(self.reach[a], self.reach[b])
        self.u, self.v = np.r_[self.u[rest], a[keep]], np.r_[self.v[rest], b[keep]]
        self.d, self.exact = np.r_[self.d[rest], d[keep]], np.r_[self.exact[rest], exact[keep]]


def tree(x: np.ndarray, w: np.ndarray, search: Search, dense: int, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height, i, j) of all merges. `search(label, wanted, k)` gives clusters, reaches and links, as `Merging.learn` takes them."""
    m = Merging(x, w)
    while (left := int(m.alive.sum())) > dense:
        best = m.least(np.where(m.exact, m.d, np.inf))
        lost = np.flatnonzero(m.alive & ((best > m.reach) | (m.reach < 0)))
        m.learn(*search(m.label, lost, nearest))
        while left > dense and (merged := m.step()):
            left -= merged
    ids = np.flatnonzero(m.alive)
    if len(ids) > 1:
        d = np.empty((len(ids), len(ids)))
        _, _, u, v, mean = search(m.label, ids, len(ids))
        u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
        d[u, v] = d[v, u] = mean
        np.fill_diagonal(d, np.inf)
        height, i, j = kernels.linkage_merges(d, m.weight[ids])
        m.merges.append((height, ids[i], ids[j]))
    return tuple(np.concatenate(c) for c in zip(*m.merges, strict=True)) if m.merges else (np.empty(0), np.empty(0, int), np.empty(0, int))


def searcher(spark: SparkSession, x: np.ndarray, w: np.ndarray) -> Search:
    """Searches in tasks, each over some of the clusters; those of few rows go without a job."""
    rows = spark.sparkContext.broadcast((x, w))

    def search(label: np.ndarray, wanted: np.ndarray, k: int) -> Found:
        def found(space: Space, mine: np.ndarray) -> pa.RecordBatch:
            who, reach, links, d = zip(*space.nearest(mine, k), strict=True)
            ends = pa.array(np.cumsum([0, *map(len, links)]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in (links, d))
            return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(reach, pa.float64()), *lists], ["who", "reach", "links", "d"])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = Space(*rows.value, label)
            for part in parts:
                for n in part.column(0).to_pylist():
                    for some in batches[n * BATCHES : (n + 1) * BATCHES]:
                        yield found(space, space.place[some])

        size = np.bincount(label)[wanted]
        by = np.lexsort((wanted, size))
        batches = list(blocks(size[by], wanted[by], ROWS))
        if size.sum() <= ROWS:
            space = Space(x, w, label)
            table = pa.Table.from_batches([found(space, space.place[some]) for some in batches])
        else:
            tasks = -(-len(batches) // BATCHES)
            table = spark.range(0, tasks, 1, tasks).mapInArrow(run, "who long, reach double, links array<long>, d array<double>").toArrow()
        links, d = table["links"].combine_chunks(), table["d"].combine_chunks()
        who = table["who"].to_numpy()
        return who, table["reach"].to_numpy(), np.repeat(who, pc.list_value_length(links).to_numpy()), links.flatten().to_numpy(), d.flatten().to_numpy()

    return search


def average_labels(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Labels of the k groups that average linkage leaves, numbered as they first occur by key.

    Equal vectors stay together, so fewer distinct ones than k are their own groups. Vectors that are null or hold a
    component that is null or not finite have no label. The driver holds the vectors and NEAREST links of each.
    """
    rows = df.select(key, F.col(vector).cast("array<double>").alias("x")).toArrow()
    rows = rows.take(pc.sort_indices(rows, [(key, "ascending")]))
    whole = np.flatnonzero(rows["x"].is_valid().to_numpy())
    x, rows = rows["x"].take(pa.array(whole)).combine_chunks(), rows.drop_columns("x")
    length = pc.list_value_length(x).to_numpy()
    if len(np.unique(length)) > 1:
        raise ValueError("vectors of several lengths have no distances")
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), length[0] if len(length) else 0) + 0.0  # one zero
    finite = np.isfinite(x).all(axis=1)
    x, whole = np.ascontiguousarray(x[finite]), whole[finite]
    label = np.full(rows.num_rows, -1)
    if x.size:
        _, first, of, copies = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
        x = np.ldexp(x[first], -int(np.frexp(np.abs(x).max())[1]))  # squares stay finite
        x -= x.mean(axis=0)
        merges = tree(x, copies, searcher(df.sparkSession, x, copies), DENSE, NEAREST)
        of = kernels.cut_merges(len(x), *merges, k)[of]
        _, seen, of = np.unique(of, return_index=True, return_inverse=True)
        label[whole] = np.argsort(np.argsort(seen))[of]
    elif len(whole):
        label[whole] = 0  # vectors without components are equal
    out = pa.table({key: rows[key], "label": pa.array(label, pa.int32(), mask=label < 0)})
    return df.sparkSession.createDataFrame(out).select(F.col(key).cast(df.schema[key].dataType), "label")
