"""Loops of sustained sounds: steady region, period, candidate bounds, quality gates, settlement. Numpy over one signal."""

from __future__ import annotations

import numpy as np

from rateloom.functions import kernels


def autocorrelation(x: np.ndarray) -> np.ndarray:
    x = x - x.mean() if len(x) else x
    spectrum = np.fft.rfft(x, 2 * max(len(x), 1))
    out = np.fft.irfft(spectrum * np.conj(spectrum))[: len(x)]
    return out / out[0] if len(out) and out[0] > 0 else np.zeros(len(x))


def refined_lag(r: np.ndarray, lag: int) -> float:
    """Vertex of the parabola through a peak and its neighbours, within half a sample."""
    if not 0 < lag < len(r) - 1:
        return float(lag)
    a, b, c = r[lag - 1 : lag + 2]
    bend = a - 2 * b + c
    return lag + float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else float(lag)


def estimate_period(x: np.ndarray, low: int, high: int, margin: float = 0.1) -> float | None:
    """The shortest of the octaves below the strongest lag whose peak comes within the margin of it."""
    r = autocorrelation(x)
    high = min(high, len(r) - 1)
    if high <= low:
        return None
    best = low + int(r[low : high + 1].argmax())
    if r[best] <= 0:
        return None
    at = best
    while at // 2 >= low:
        half = at // 2
        near = np.arange(max(low, half - 2), min(high, half + 2) + 1)
        peak = int(near[r[near].argmax()])
        if r[peak] < r[best] * (1 - margin):
            break
        at = peak
    return refined_lag(r, at)


def steady_region(x: np.ndarray, window: int, tolerance_db: float = 3.0) -> tuple[int, int] | None:
    """Longest run of windows whose level stays within the tolerance of the run's first."""
    n = len(x) // window
    if n < 2:
        return None
    level = 10 * np.log10((x[: n * window].reshape(n, window) ** 2).mean(axis=1) + 1e-12)
    best = (0, 0)
    for a in range(n):
        apart = np.flatnonzero(np.abs(level[a:] - level[a]) > tolerance_db)
        length = int(apart[0]) if len(apart) else n - a
        if length > best[1]:
            best = (a, length)
    return (best[0] * window, (best[0] + best[1]) * window) if best[1] >= 2 else None


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    scale = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / scale) if scale > 0 else 0.0


def ascending_zero(x: np.ndarray, at: int, radius: int) -> int:
    """Nearest place within the radius where the signal rises through zero; the place itself where there is none."""
    low, high = max(1, at - radius), min(len(x) - 1, at + radius)
    if high < low:
        return at
    k = np.arange(low, high + 1)
    k = k[(x[k - 1] < 0) & (x[k] >= 0)]
    return int(k[np.abs(k - at).argmin()]) if len(k) else at


def matched_end(x: np.ndarray, start: int, around: int, radius: int, span: int) -> int:
    """The end near a place whose following samples are most alike those after the start."""
    ends = [e for e in range(max(start + span, around - radius), min(len(x) - span, around + radius) + 1)]
    if not ends:
        return around
    ref = x[start : start + span]
    return max(ends, key=lambda e: cosine(ref, x[e : e + span]))


def seam_step(x: np.ndarray, start: int, end: int) -> float:
    """Jump over the seam against the mean motion inside."""
    motion = np.abs(np.diff(x[start:end])).mean() if end - start > 1 else 0.0
    return float(abs(x[start] - x[end - 1]) / motion) if motion > 0 else 0.0


def level_drift_db(x: np.ndarray, start: int, end: int) -> float:
    quarter = max(1, (end - start) // 4)
    power = lambda s: 10 * np.log10((s**2).mean() + 1e-12)
    return float(power(x[start : start + quarter]) - power(x[end - quarter : end]))


def spectral_gap_db(x: np.ndarray, start: int, end: int) -> float:
    """RMS difference of the log spectra of the region's halves; 0 below 1,024 samples."""
    half = (end - start) // 2
    if half < 512:
        return 0.0
    a, b = (20 * np.log10(np.abs(np.fft.rfft(x[s : s + half] * np.hanning(half))) + 1e-6) for s in (start, end - half))
    return float(np.sqrt(((a - b) ** 2).mean()))


def search(x: np.ndarray, rate: int, low_hz: float, high_hz: float, periods: int = 4, offers: int = 4) -> tuple[list[tuple[int, int]], str]:
    """Candidate (start, end) bounds, shortest first, or none and what was lacking."""
    region = steady_region(x, max(64, rate // 50))
    if region is None:
        return [], "steady region"
    a, b = region
    period = estimate_period(x[a:b], max(2, int(rate / high_hz)), int(rate / low_hz))
    if period is None:
        return [], "period"
    least = int(np.ceil(periods * period))
    if b - a < least + int(2 * period):
        return [], "length"
    start = ascending_zero(x, a + int(period), int(period))
    most = int((b - start - period) // period)
    lengths = np.unique(np.linspace(periods, max(periods, most), offers).round().astype(int))
    span = max(8, int(period))
    found = {(start, matched_end(x, start, start + int(round(k * period)), max(2, int(period / 8)), span)) for k in lengths if start + k * period + span <= len(x)}
    return sorted(f for f in found if f[1] - f[0] >= 2), ""


def settle(x: np.ndarray, bounds: list[tuple[int, int]], seam_limit: float = 6.0, drift_db: float = 6.0, timbre_db: float = 18.0) -> list[dict]:
    """Each candidate with its quality and the first gate it fails: seam, level, then timbre."""
    out = []
    for start, end in bounds:
        closed = kernels.crossfade_loop(x, start, end, max(1, (end - start) // 8))
        q = {"start": start, "end": end, "seam": seam_step(closed, start, end), "drift_db": level_drift_db(closed, start, end), "timbre_db": spectral_gap_db(closed, start, end)}
        gates = (("seam", q["seam"] > seam_limit), ("level", abs(q["drift_db"]) > drift_db), ("timbre", q["timbre_db"] > timbre_db))
        out.append(q | {"rejected": next((name for name, bad in gates if bad), None)})
    return out


def wrapped(x: np.ndarray, start: int, end: int, length: int) -> np.ndarray:
    """The sound with its loop repeated to a length."""
    if length <= end:
        return x[:length].copy()
    body = x[start:end]
    return np.concatenate([x[:end], np.tile(body, -(-(length - end) // len(body)))[: length - end]])
