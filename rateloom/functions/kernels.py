"""Numpy kernels for sequential or iterative work inside one group: solvers, fits, transforms, clustering.

They run in applyInPandas or pandas UDFs, one bounded group at a time.
"""

from __future__ import annotations

import numpy as np


def mckp_exact(items: list[list[tuple[int, float]]], budget: int) -> tuple[float, list[int]] | None:
    """One point (bytes, loss) of each item within the budget at the least total loss; None if nothing fits."""
    best = np.full(budget + 1, np.inf)
    best[0] = 0.0
    back = []
    for points in items:
        table = np.full((len(points), budget + 1), np.inf)
        for k, (size, loss) in enumerate(points):
            if size <= budget:
                table[k, size:] = best[: budget + 1 - size] + loss
        choice = table.argmin(axis=0)
        back.append(choice)
        best = table.min(axis=0)
    if not np.isfinite(best).any():
        return None
    at = int(best.argmin())
    value, picks = float(best[at]), []
    for points, choice in zip(reversed(items), reversed(back), strict=True):
        k = int(choice[at])
        picks.append(k)
        at -= points[k][0]
    return value, picks[::-1]


def partition_exact(
    n: int, zones: dict[tuple[int, int], list[tuple[int, float]]], budget: int, most: int | None = None, grid: int = 1,
) -> tuple[float, int, list[tuple[int, int, int]]] | None:
    """Cut 0..n-1 into zones (start, stop inclusive), each with one of its options (bytes, loss), within the budget.

    most: at most so many zones; only then is there a layer for each number of zones. grid: bytes are counted in steps of
    this size, each option rounded up, so that a plan always fits and the tables shrink by the step. Returns loss, bytes
    and (start, stop, option).
    """
    room = budget // grid
    listed = [(a, b, k, size, -(-size // grid), loss) for (a, b), some in sorted(zones.items()) for k, (size, loss) in enumerate(some) if -(-size // grid) <= room]
    layers = most if most else 0
    best = np.full((layers + 1, n + 1, room + 1), np.inf)
    back = np.full(best.shape, -1, np.int32)
    best[0, 0, 0] = 0.0
    for used in range(max(layers, 1)):
        onto = used + 1 if layers else 0
        for number, (start, stop, _, _, steps, loss) in enumerate(listed):  # by start: all that ends before it is final
            cand = best[used, start, : room + 1 - steps] + loss
            target = best[onto, stop + 1, steps:]
            better = cand < target - 1e-15
            target[better] = cand[better]
            back[onto, stop + 1, steps:][better] = number
    final = best[:, n]
    if not np.isfinite(final).any():
        return None
    used, at = map(int, np.unravel_index(int(final.argmin()), final.shape))
    value, spent, out, stop = float(final[used, at]), 0, [], n
    while stop > 0:
        start, last, k, size, steps, _ = listed[back[used, stop, at]]
        out.append((start, last, k))
        spent, at, stop, used = spent + size, at - steps, start, used - 1 if layers else 0
    return value, spent, out[::-1]


def lower_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Pareto frontier, then the lower convex hull, by one pass with a stack."""
    out: list[tuple[float, float]] = []
    for x, y in sorted(points):
        if out and (y >= out[-1][1] - 1e-12 or x == out[-1][0]):
            continue
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (x - out[-1][0]) >= (y - out[-1][1]) * (out[-1][0] - out[-2][0]) - 1e-12:
            out.pop()
        out.append((x, y))
    return out


def piecewise_fit(x: np.ndarray, y: np.ndarray, corners: int) -> tuple[np.ndarray, np.ndarray]:
    """Continuous piecewise-linear fit with at most so many corners: best stretches by dynamic programming, then values."""
    n = len(x)
    if n <= 2 or corners <= 2:
        idx = np.array([0, n - 1]) if n > 1 else np.array([0])
    else:
        z = np.zeros(1)
        sx, sy, sxx, sxy, syy = (np.concatenate([z, np.cumsum(v)]) for v in (x, y, x * x, x * y, y * y))
        pieces = min(corners - 1, n - 1)
        best = np.full((pieces, n), np.inf)  # of the first 1, 2, ... stretches up to each place; memory grows with n, not its square
        trace = np.full((pieces, n), -1)
        for i in range(n):  # best[:, i] is final here, for stretches begin at i and end beyond it
            m = np.arange(2.0, n - i + 1)
            a, b, c, d, e = (s[i + 2 :] - s[i] for s in (sx, sy, sxx, sxy, syy))
            vx, vxy, vy = c - a * a / m, d - a * b / m, e - b * b / m
            cost = np.maximum(vy - np.where(vx > 0, vxy * vxy / np.where(vx > 0, vx, 1), 0), 0)
            if i == 0:
                best[0, 1:] = cost
            for k in range(1, pieces):
                if best[k - 1, i] < best[k, i]:
                    best[k, i], trace[k, i] = best[k - 1, i], -1
                total = best[k - 1, i] + cost
                better = total < best[k, i + 1 :]
                best[k, i + 1 :][better] = total[better]
                trace[k, i + 1 :][better] = i
        idx, at = [n - 1], n - 1
        for step in reversed(trace[1:]):
            if step[at] > 0:
                at = int(step[at])
                idx.append(at)
        idx = np.unique([0, *idx])
    knots = x[idx]
    basis = np.stack([np.interp(x, knots, row) for row in np.eye(len(knots))], axis=1)
    values, *_ = np.linalg.lstsq(basis, y, rcond=None)
    return knots, values


def shared_trajectory(moment: np.ndarray, group: np.ndarray, value: np.ndarray, weight: np.ndarray, sweeps: int = 32, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Alternating weighted means: a shape over moments and an offset for each group, offsets of weighted mean zero."""
    shape, offset = np.zeros(moment.max() + 1), np.zeros(group.max() + 1)
    per_moment, per_group = np.bincount(moment, weight), np.bincount(group, weight)
    for _ in range(sweeps):
        shape = np.bincount(moment, weight * (value - offset[group])) / np.maximum(per_moment, 1e-300)
        new = np.bincount(group, weight * (value - shape[moment])) / np.maximum(per_group, 1e-300)
        new -= (new * per_group).sum() / per_group.sum()
        moved, offset = np.abs(new - offset).max(), new
        if moved < tolerance:
            break
    return shape, offset


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances by one matrix product; those that it can't give to full precision are taken from differences."""
    with np.errstate(all="ignore"):
        finite = x[np.isfinite(x).all(axis=1)]
        center = finite.mean(axis=0) if len(finite) else 0.0
        a, b = x - center, y - center
        scale = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
        out = scale - 2 * (a @ b.T)
        far = out > 0.01 * scale  # near pairs cancel; infinite ones give no number
        if not far.all() or not np.isfinite(out).all():
            i, j = np.nonzero(~(far & np.isfinite(out)))
            for at in range(0, len(i), 1 << 15):
                d = x[i[at : at + (1 << 15)]] - y[j[at : at + (1 << 15)]]
                out[i[at : at + (1 << 15)], j[at : at + (1 << 15)]] = (d * d).sum(axis=1)
        return np.sqrt(out, out=out)


def linkage_labels(x: np.ndarray, k: int, method: str = "average") -> np.ndarray:
    """Agglomerative clustering by chains of nearest neighbours and Lance-Williams updates, cut into k groups."""
    n = len(x)
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0)
    if method != "ward":
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    return cut_merges(n, *linkage_merges(d, np.ones(n), method), k)


def linkage_merges(d: np.ndarray, size: np.ndarray, method: str = "average") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(height, i, j) of all merges of clusters of these sizes; i stands for both from then on. Overwrites the distances."""
    n = len(d)
    size, merges, chain, alive = size.astype(float), [], [], np.ones(n, bool)
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        height = d[i, j]
        merges.append((height, i, j))
        if method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / (size[i] + size[j] + size)
        new[[i, j]] = np.inf
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    height, i, j = zip(*merges) if merges else ((), (), ())
    return np.array(height, float), np.array(i, int), np.array(j, int)


def cut_merges(n: int, height: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Labels of the k groups that the lowest merges leave, numbered as they first occur."""
    parent = np.arange(n)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for m in np.argsort(height, kind="stable")[: max(n - k, 0)]:
        parent[find(j[m])] = find(i[m])
    roots = [find(a) for a in range(n)]
    number: dict[int, int] = {}
    return np.array([number.setdefault(r, len(number)) for r in roots])


def kmeans_labels(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centers)
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


def classical_scaling(d: np.ndarray, dims: int) -> np.ndarray:
    """Coordinates from a distance matrix by the double-centred eigenproblem; signs fixed by the largest entry."""
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = values.argsort()[::-1][:dims]
    out = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return out * np.where(np.take_along_axis(out, np.abs(out).argmax(0)[None], 0)[0] < 0, -1, 1)


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """FFT resampling to n samples."""
    m = len(x)
    if m == n or not m:
        return x.copy()
    spectrum, half = np.fft.rfft(x), min(n, m) // 2 + 1
    out = np.zeros(n // 2 + 1, complex)
    out[:half] = spectrum[:half]
    if min(n, m) % 2 == 0:
        out[half - 1] *= 0.5 if n > m else 1.0
        if n < m:
            out[half - 1] = 2 * out[half - 1].real if n % 2 == 0 else out[half - 1]
            out[half - 1] *= 0.5
    return np.fft.irfft(out, n) * n / m


def bandlimit(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    spectrum = np.fft.rfft(x)
    f = np.fft.rfftfreq(len(x), 1 / rate)
    spectrum[(f < low) | (f >= high)] = 0
    return np.fft.irfft(spectrum, len(x))


def local_level(x: np.ndarray, kernel: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Windowed RMS, normalised by the weight that the window covers."""
    if len(kernel) > len(x):  # a window no longer than the signal
        cut = (len(kernel) - len(x) + 1) // 2
        kernel = kernel[cut : cut + len(x)]
    power = np.convolve(x * x, kernel, "same") / np.maximum(np.convolve(np.ones_like(x), kernel, "same"), 1e-300)
    return np.sqrt(np.maximum(power, 0) + floor * floor)


def decompose(x: np.ndarray, kernel: np.ndarray, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Level and carrier, whose product is the signal."""
    level = local_level(x, kernel, floor)
    return level, x / level


def crossfade_loop(x: np.ndarray, start: int, end: int, blend: int) -> np.ndarray:
    """The region's last samples blend into those before its start, with weights that keep the power at their correlation."""
    out = x.copy()
    blend = min(blend, start, end - start)
    if blend < 1:
        return out
    tail, lead = x[end - blend : end], x[start - blend : start]
    scale = np.sqrt((tail @ tail) * (lead @ lead))
    r = float(np.clip(tail @ lead / scale, 0, 1)) if scale > 0 else 0.0
    t = (np.arange(blend) + 1) / (blend + 1)
    norm = np.sqrt((1 - t) ** 2 + t**2 + 2 * r * t * (1 - t))
    out[end - blend : end] = ((1 - t) * tail + t * lead) / norm
    return out
