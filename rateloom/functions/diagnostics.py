"""Diagnostics and distances between two signals, from their magnitudes: expressions on array<double> columns.

Magnitudes are those of bins 0..n/2 of a signal of n samples (`arrays.dft_magnitude`). Band sums over them equal sums
over samples by Parseval's theorem, so a band-limited ratio needs no inverse transform.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rateloom.functions import arrays as A


def in_band(n: int, rate: float, low: float, high: float) -> list[int]:
    """Bins whose frequency lies in [low, high)."""
    return [k for k in range(n // 2 + 1) if low <= k * rate / n < high]


def band_energy(magnitude: Column, n: int, rate: float, low: float, high: float) -> Column:
    """Sum of squared magnitudes of the bins in [low, high)."""
    held = set(in_band(n, rate, low, high))
    return A.dot(F.transform(magnitude, lambda m: m * m), A.constant(k in held for k in range(n // 2 + 1)))


def band_power(magnitude: Column, n: int, rate: float, low: float, high: float) -> Column:
    """Energy of the samples that the band holds: every bin but the first and an even signal's last stands for two."""
    held = set(in_band(n, rate, low, high))
    shares = [(1 if k == 0 or 2 * k == n else 2) / n * (k in held) for k in range(n // 2 + 1)]
    return A.dot(F.transform(magnitude, lambda m: m * m), A.constant(shares))


def hf_loss_db(ref: Column, cand: Column, n: int, rate: float, cutoff: float) -> Column:
    """Energy lost above the cutoff, in decibels; positive where the candidate is duller."""
    above = [band_energy(m, n, rate, cutoff, rate / 2) + A.EPS for m in (ref, cand)]
    return F.lit(10.0) * F.log10(above[0] / above[1])


def band_snr(ref: Column, error: Column, n: int, rate: float, low: float, high: float) -> Column:
    """Signal-to-noise ratio within a band, from the magnitudes of the reference and of the difference; infinite without noise."""
    noise = band_power(error, n, rate, low, high)
    ratio = F.lit(10.0) * F.log10((band_power(ref, n, rate, low, high) + A.EPS) / F.nullif(noise, F.lit(0.0)))
    return F.coalesce(ratio, F.lit(math.inf))


def frame_magnitudes(x: Column, length: int, hop: int) -> Column:
    """Hann-windowed magnitudes of each frame."""
    return F.transform(A.frames(x, length, hop), lambda f: A.dft_magnitude(f, length, window=True))


def flux_series(spectra: Column) -> Column:
    """Distance of each frame's spectrum from the one before; a single frame changes by nothing."""
    later = F.slice(spectra, F.lit(2), F.size(spectra) - 1)
    moved = F.transform(later, lambda s, k: A.flux(F.get(spectra, k), s))
    return F.when(F.size(spectra) < 2, F.array(F.lit(0.0))).otherwise(moved)


def spread(x: Column) -> Column:
    """Population standard deviation of the elements."""
    middle = A.mean(x)
    return F.sqrt(A.mean(F.transform(x, lambda v: (v - middle) * (v - middle))))


def floored_log(values: Column, peak: Column, down_db: float) -> Column:
    """Natural logarithm of powers, none read lower than so many decibels under the peak."""
    floor = F.greatest(peak * 10.0 ** (-down_db / 10), F.lit(1e-12))
    return F.transform(values, lambda v: F.ln(F.greatest(v, floor)))


def log_mel_distance(ref: Column, cand: Column, length: int, rate: float, bands: int, down_db: float) -> Column:
    """Mean absolute difference of logarithmic mel powers over the frames both have; ref and cand are frame magnitudes."""
    common = F.least(F.size(ref), F.size(cand))

    def powers(spectra: Column) -> Column:
        return F.flatten(F.transform(F.slice(spectra, F.lit(1), common), lambda s: A.mel_energies(s, length // 2 + 1, rate, bands)))

    a, b = powers(ref), powers(cand)
    top = F.array_max(a)
    return A.mean(F.zip_with(floored_log(a, top, down_db), floored_log(b, top, down_db), lambda p, q: F.abs(p - q)))


def relative_delta(ref: Column, cand: Column) -> Column:
    return F.abs(ref - cand) / (F.abs(ref) + A.EPS)


def shape_readings(spectra: Column, length: int, rate: float, share: float) -> dict[str, Column]:
    """Brightness, rolloff and flatness averaged over the frames, and how much the flux varies."""
    freqs = [k * rate / length for k in range(length // 2 + 1)]
    rolloff = F.transform(spectra, lambda s: A.rolloff_bin(s, share) * F.lit(rate / length) * (A.total(s) > 0).cast("double"))
    return {
        "centroid": A.mean(F.transform(spectra, lambda s: A.centroid(s, freqs))),
        "rolloff": A.mean(rolloff),
        "flatness": A.mean(F.transform(spectra, lambda s: A.flatness(F.transform(s, lambda m: m * m)))),
        "flux": spread(flux_series(spectra)),
    }


def spectral_shape(ref: Column, cand: Column, length: int, rate: float, share: float, weights: dict[str, float]) -> Column:
    """Weighted distance of two signals' readings, relative but for the flatness; ref and cand are frame magnitudes."""
    a, b = (shape_readings(s, length, rate, share) for s in (ref, cand))
    parts = [F.lit(float(w)) * (F.abs(a[k] - b[k]) if k == "flatness" else relative_delta(a[k], b[k])) for k, w in weights.items()]
    return sum(parts[1:], parts[0])
