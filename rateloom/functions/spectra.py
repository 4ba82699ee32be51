"""Short-time spectra, cepstra, bands and filters of one long signal, in numpy."""

from __future__ import annotations

import numpy as np

from rateloom.functions import arrays


def framed(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    if len(x) < length:
        x = np.concatenate([x, np.zeros(length - len(x))])
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def stft_magnitude(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    return np.abs(np.fft.rfft(framed(x, length, hop) * np.hanning(length), axis=1))


def mel_spectrogram(x: np.ndarray, rate: float, length: int, hop: int, bands: int) -> np.ndarray:
    return stft_magnitude(x, length, hop) ** 2 @ np.array(arrays.mel_bank(length // 2 + 1, rate, bands)).T


def dct_matrix(n: int, k: int) -> np.ndarray:
    scale = np.full(k, np.sqrt(2 / n))
    scale[0] = np.sqrt(1 / n)
    return scale[:, None] * np.cos(np.pi * np.arange(k)[:, None] * (np.arange(n) + 0.5) / n)


def mfcc(x: np.ndarray, rate: float, length: int, hop: int, bands: int, coefficients: int, top_db: float = 80.0) -> np.ndarray:
    power = mel_spectrogram(x, rate, length, hop, bands)
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db, db.max() - top_db) @ dct_matrix(bands, coefficients).T


def cepstral_distortion(a: np.ndarray, b: np.ndarray, rate: float, length: int = 64, hop: int = 32, bands: int = 12, coefficients: int = 8) -> float:
    """Mean distance of cepstra without the level coefficient, in dB; 0 without frames."""
    n = min(len(a), len(b))
    if not n:
        return 0.0
    d = (mfcc(a[:n], rate, length, hop, bands, coefficients) - mfcc(b[:n], rate, length, hop, bands, coefficients))[:, 1:]
    return float(10 / np.log(10) * np.sqrt(2) * np.sqrt((d**2).sum(axis=1)).mean() / 10)


def multi_resolution_distance(a: np.ndarray, b: np.ndarray, lengths: tuple[int, ...] = (16, 32, 64), floor: float = 1e-4) -> float:
    """Mean over resolutions of spectral convergence and the floored log-magnitude difference."""
    out = []
    for n in lengths:
        p, q = stft_magnitude(a, n, n // 4), stft_magnitude(b, n, n // 4)
        top = max(p.max(), 1e-12) * floor
        out.append(np.linalg.norm(p - q) / max(np.linalg.norm(p), 1e-12) + np.abs(np.log(np.maximum(p, top)) - np.log(np.maximum(q, top))).mean())
    return float(np.mean(out))


def band_masks(n: int, rate: float, crossovers: list[float], width: float = 0.25) -> np.ndarray:
    """Masks over the bins of n samples that add up to one: raised-cosine steps around each crossover."""
    f = np.fft.rfftfreq(n, 1 / rate)
    steps = [np.ones_like(f)]
    for c in sorted(crossovers):
        t = np.clip((f - c * (1 - width)) / (2 * c * width), 0, 1)
        steps.append(0.5 - 0.5 * np.cos(np.pi * t))
    steps.append(np.zeros_like(f))
    return np.array([a - b for a, b in zip(steps, steps[1:])])


def split_bands(x: np.ndarray, rate: float, crossovers: list[float]) -> np.ndarray:
    """Bands that add up to the signal."""
    return np.fft.irfft(np.fft.rfft(x)[None] * band_masks(len(x), rate, crossovers), len(x), axis=1)


def one_pole(x: np.ndarray, rise: float, fall: float) -> np.ndarray:
    """One-pole lag with its own rise and fall, from the first value on."""
    out = np.empty(len(x))
    y = x[0] if len(x) else 0.0
    for k, v in enumerate(x):
        y += (v - y) * (rise if v > y else fall)
        out[k] = y
    return out


def high_pass(x: np.ndarray, rate: float, cutoff: float, order: int = 4) -> np.ndarray:
    """Zero-phase high-pass with a Butterworth magnitude, applied to the spectrum of the reflected signal."""
    if not len(x):
        return x.copy()
    wide = np.concatenate([x[::-1], x, x[::-1]])
    f = np.fft.rfftfreq(len(wide), 1 / rate)
    gain = np.zeros_like(f)
    gain[1:] = 1 / (1 + (cutoff / f[1:]) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(wide) * gain, len(wide))[len(x) : 2 * len(x)]


def harmonic_profile(x: np.ndarray, rate: float, pitch_hz: float, partials: int, length: int, hop: int) -> np.ndarray:
    """dB of the strongest bin around each partial, frame mean removed: frames by partials."""
    mag = stft_magnitude(x, length, hop)
    width = rate / length
    out = []
    for k in range(1, partials + 1):
        low, high = (k - 0.5) * pitch_hz / width, (k + 0.5) * pitch_hz / width
        a = min(int(np.ceil(low)), mag.shape[1] - 1)
        out.append(mag[:, a : max(a + 1, min(int(high) + 1, mag.shape[1]))].max(axis=1))
    db = 20 * np.log10(np.maximum(np.array(out).T, 1e-9))
    return db - db.mean(axis=1, keepdims=True)


def integrated_level_db(x: np.ndarray, rate: float, window_s: float = 0.4) -> float | None:
    """Gated level in dB: windows under -70 dB, then those 10 dB below the rest, are left out. None for silence."""
    n = max(1, int(rate * window_s))
    power = (framed(x, min(n, max(len(x), 1)), max(1, min(n, max(len(x), 1)) // 4)) ** 2).mean(axis=1)
    loud = power[power > 1e-7]
    if not len(loud):
        return None
    loud = loud[loud >= loud.mean() / 10]
    return float(10 * np.log10(loud.mean()))
