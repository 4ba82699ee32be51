"""Operators on array<double> columns, as higher-order functions: framing, levels, spectra, metrics, quantization.

Each row holds a signal; nothing is exploded or shuffled. Short transforms (a few hundred samples) are plain sums
against cosine tables; long signals go through the numpy kernels of rateloom.functions.kernels instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def constant(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def frames(x: Column, length: int, hop: int) -> Column:
    """Overlapping frames; a signal shorter than one frame is padded with zeros to one."""
    padded = F.when(F.size(x) < length, F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(x), F.lit(0))))).otherwise(x)
    count = F.floor((F.size(padded) - length) / hop).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(padded, i * hop + 1, F.lit(length)))


def hann(n: int) -> list[float]:
    """Symmetric Hann window."""
    return [1.0] if n == 1 else [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]


def dft_magnitude(x: Column, n: int, window: bool = False) -> Column:
    """Magnitudes of bins 0..n/2 of a signal of n samples."""
    taper = hann(n) if window else [1.0] * n
    out = []
    for k in range(n // 2 + 1):
        re = dot(x, constant(taper[t] * math.cos(2 * math.pi * k * t / n) for t in range(n)))
        im = dot(x, constant(taper[t] * math.sin(2 * math.pi * k * t / n) for t in range(n)))
        out.append(F.sqrt(re * re + im * im))
    return F.array(*out)


def dct2(x: Column, n: int, coefficients: int) -> Column:
    """Orthonormal DCT-II, the first coefficients."""
    rows = []
    for k in range(coefficients):
        scale = math.sqrt((1 if k == 0 else 2) / n)
        rows.append(dot(x, constant(scale * math.cos(math.pi * (t + 0.5) * k / n) for t in range(n))))
    return F.array(*rows)


def mel_bank(bins: int, rate: float, bands: int) -> list[list[float]]:
    """Triangular bank on the HTK mel scale."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz(mel(rate / 2) * k / (bands + 1)) for k in range(bands + 2)]
    freqs = [k * rate / 2 / (bins - 1) for k in range(bins)]
    return [[max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f in freqs] for a, b, c in zip(edges, edges[1:], edges[2:])]


def mel_energies(magnitude: Column, bins: int, rate: float, bands: int) -> Column:
    power = F.transform(magnitude, lambda m: m * m)
    return F.array(*(dot(power, constant(row)) for row in mel_bank(bins, rate, bands)))


def centroid(magnitude: Column, freqs: list[float]) -> Column:
    return F.coalesce(dot(magnitude, constant(freqs)) / F.nullif(total(magnitude), F.lit(0.0)), F.lit(0.0))


def rolloff_bin(magnitude: Column, share: float) -> Column:
    """First bin at which the running sum reaches the share of the total."""
    limit = total(magnitude) * share
    state = F.aggregate(
        magnitude, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin")),
        lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["bin"] + F.when(a["sum"] + v < limit, 1).otherwise(0)).alias("bin")),
    )
    return F.least(state["bin"], F.size(magnitude) - 1)


def flatness(power: Column) -> Column:
    logs = mean(F.transform(power, lambda p: F.ln(p + EPS)))
    return F.exp(logs) / mean(F.transform(power, lambda p: p + EPS))


def flux(before: Column, after: Column) -> Column:
    return F.sqrt(energy(F.zip_with(after, before, lambda a, b: a - b)))


def autocorrelation(x: Column, lags: int) -> Column:
    """Mean-removed, lag 0 is 1."""
    m = mean(x)
    centered = F.transform(x, lambda v: v - m)
    zero = F.nullif(energy(centered), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda k: dot(F.slice(centered, F.lit(1), F.size(x) - k), F.slice(centered, k + 1, F.size(x) - k)) / zero)


def noise(ref: Column, cand: Column) -> Column:
    return F.zip_with(ref, cand, lambda a, b: a - b)


def snr(ref: Column, cand: Column) -> Column:
    return F.lit(10.0) * F.log10((energy(ref) + EPS) / (energy(noise(ref, cand)) + EPS))


def si_sdr(ref: Column, cand: Column) -> Column:
    """Scale-invariant signal to distortion ratio."""
    gain = dot(ref, cand) / F.nullif(energy(ref), F.lit(0.0))
    target = F.transform(ref, lambda v: v * gain)
    return F.lit(10.0) * F.log10((energy(target) + EPS) / (energy(noise(target, cand)) + EPS))


def segmental_snr(ref: Column, cand: Column, length: int, low: float, high: float) -> Column:
    """Mean of clipped frame ratios over frames that sound; 0 if none does."""
    pairs = F.zip_with(frames(ref, length, length), frames(cand, length, length), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    heard = F.filter(pairs, lambda p: energy(p["a"]) > EPS)
    ratios = F.transform(heard, lambda p: F.greatest(F.least(snr(p["a"], p["b"]), F.lit(high)), F.lit(low)))
    return F.coalesce(mean(ratios), F.lit(0.0))


def normalize_peak(x: Column, target: float) -> Column:
    gain = F.coalesce(F.lit(target) / F.nullif(peak(x), F.lit(0.0)), F.lit(1.0))
    return F.transform(x, lambda v: v * gain)


def release_fade(x: Column, n: int) -> Column:
    """Linear ramp to zero over the last n samples."""
    return F.transform(x, lambda v, i: v * F.least(F.lit(1.0), (F.size(x) - 1 - i) / F.lit(float(max(n, 1)))))


def quantize(x: Column, depth: int) -> Column:
    """Signed grid of the depth: rounded half-even, clamped."""
    scale = float(1 << (depth - 1))
    return F.transform(x, lambda v: F.least(F.greatest(F.bround(v * scale, 0), F.lit(-scale)), F.lit(scale - 1)) / scale)


def noise_shaped(x: Column, depth: int) -> Column:
    """First-order error feedback: each sample takes on what the one before lost."""
    scale = float(1 << (depth - 1))

    def step(acc: Column, v: Column) -> Column:
        want = v + acc["carry"]
        got = F.least(F.greatest(F.bround(want * scale, 0), F.lit(-scale)), F.lit(scale - 1)) / scale
        return F.struct((want - got).alias("carry"), F.concat(acc["out"], F.array(got)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(x, start, step, lambda a: a["out"])


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(energy(F.zip_with(x, y, lambda a, b: a - b)))


def content_length(x: Column, floor: float) -> Column:
    """Samples up to the last one louder than the floor."""
    loud = F.transform(x, lambda v, i: F.when(F.abs(v) > floor, i + 1).otherwise(0))
    return F.coalesce(F.array_max(loud), F.lit(0))


def first_held(flags: Column, span: int) -> Column:
    """First start of a run of span true values, or null."""
    state = F.aggregate(
        flags, F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(-1).alias("hit")),
        lambda a, v: F.struct(
            (a["at"] + 1).alias("at"), F.when(v, a["run"] + 1).otherwise(0).alias("run"),
            F.when((a["hit"] < 0) & v & (a["run"] + 1 >= span), a["at"] - span + 1).otherwise(a["hit"]).alias("hit")),
    )
    return F.when(state["hit"] >= 0, state["hit"])


def interpolate(x: Column, points: Column) -> Column:
    """Piecewise-linear value at x over a sorted array of structs (x, y), clamped at both ends."""
    low = F.array_max(F.filter(points, lambda p: p["x"] <= x))
    high = F.array_min(F.filter(points, lambda p: p["x"] >= x))
    between = low["y"] + (high["y"] - low["y"]) * F.coalesce((x - low["x"]) / F.nullif(high["x"] - low["x"], F.lit(0.0)), F.lit(0.0))
    return F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(between)
