"""The surrogate codec: resample, compress, loop, normalise, quantise, and back. Numpy over one signal."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

from rateloom.functions import kernels, loops


@dataclass(frozen=True)
class Encoding:
    rate: int
    depth: int = 16
    loop: tuple[int, int] | None = None
    compress: bool = False
    dither: bool = False
    shape: bool = False


@dataclass
class Stored:
    grid: np.ndarray
    rate: int
    depth: int
    gain: float
    loop: tuple[int, int] | None

    @property
    def stored_bytes(self) -> int:
        return len(self.grid) * self.depth // 8


def dither_rng(identity: str) -> np.random.Generator:
    """Random numbers of an identity alone, whatever the order of work."""
    return np.random.default_rng(int.from_bytes(blake2b(identity.encode(), digest_size=8).digest(), "little"))


def requantize(x: np.ndarray, depth: int, rng: np.random.Generator | None = None, shape: bool = False) -> np.ndarray:
    """Signed grid; with triangular dither if a generator is given, with first-order error feedback if shaped."""
    scale = float(1 << (depth - 1))
    noise = (rng.random(len(x)) - rng.random(len(x))) / scale if rng is not None else np.zeros(len(x))
    grid = lambda v: np.clip(np.round(v * scale), -scale, scale - 1) / scale
    if not shape:
        return grid(x + noise)
    out, carry = np.empty(len(x)), 0.0
    for k in range(len(x)):
        want = x[k] + carry
        out[k] = grid(want + noise[k])
        carry = want - out[k]
    return out


def compress(x: np.ndarray, threshold_db: float = -18.0, ratio: float = 3.0, knee_db: float = 6.0) -> np.ndarray:
    """Peak-referenced soft-knee curve on the local level."""
    peak = np.abs(x).max() if len(x) else 0.0
    if peak <= 0:
        return x.copy()
    level = kernels.local_level(x, np.hanning(257) + 1e-9)
    over = 20 * np.log10(np.maximum(level / peak, 1e-12)) - threshold_db
    bend = np.where(over <= -knee_db / 2, 0, np.where(over >= knee_db / 2, over, (over + knee_db / 2) ** 2 / (2 * knee_db)))
    return x * 10 ** (-(bend * (1 - 1 / ratio)) / 20)


def encode(x: np.ndarray, rate: int, how: Encoding, identity: str = "") -> Stored:
    """Resample, compress, cut at the loop, fill the grid, quantise."""
    n = max(1, round(len(x) * how.rate / rate))
    y = kernels.resample(np.asarray(x, float), n)
    if how.compress and how.depth <= 8:
        y = compress(y)
    loop = None
    if how.loop is not None:
        a, b = (round(p * how.rate / rate) for p in how.loop)
        if 0 <= a < b - 1 < len(y):  # a loop that collapses at this rate is left out
            y = kernels.crossfade_loop(y, a, b, max(1, (b - a) // 8))[:b]
            loop = (a, b)
    peak = np.abs(y).max()
    gain = peak if peak > 0 else 1.0
    top = 1 - 1 / (1 << (how.depth - 1))
    return Stored(requantize(y / gain * top, how.depth, dither_rng(identity) if how.dither else None, how.shape), how.rate, how.depth, gain / top, loop)


def render(stored: Stored, rate: int, frames: int, semitones: float = 0.0) -> np.ndarray:
    """Sound of a stored sample: looped to the length, repitched, at its gain, cut or padded."""
    ratio = 2 ** (semitones / 12)
    need = max(1, int(np.ceil(frames * ratio * stored.rate / rate)))
    y = stored.grid * stored.gain
    if stored.loop is not None:
        y = loops.wrapped(y, *stored.loop, need)
    y = kernels.resample(y, max(1, round(len(y) * rate / (stored.rate * ratio))))[:frames]
    return np.concatenate([y, np.zeros(frames - len(y))])


def snr(ref: np.ndarray, cand: np.ndarray) -> float:
    n = min(len(ref), len(cand))
    noise = ((ref[:n] - cand[:n]) ** 2).sum()
    return float("inf") if noise == 0 else float(10 * np.log10(((ref[:n] ** 2).sum() + 1e-12) / (noise + 1e-12)))


def content_edge(x: np.ndarray, rate: int, floor_db: float = 60.0, bands: int = 64) -> float:
    """Upper edge of the highest band whose mean power comes within the floor of the loudest."""
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
    parts = np.array_split(power, min(bands, len(power)))
    means = np.array([p.mean() for p in parts])
    loud = np.flatnonzero(means >= means.max() * 10 ** (-floor_db / 10))
    return float((loud[-1] + 1) / len(parts) * rate / 2)


def lowest_rung(ladder: list[int], useful_hz: float) -> int:
    """The least rate that carries the band, else the highest."""
    fits = [r for r in sorted(ladder) if r >= useful_hz]
    return fits[0] if fits else max(ladder)


def operating_point(x: np.ndarray, rate: int, how: Encoding, identity: str = "") -> tuple[int, float]:
    """(stored bytes, distortion): RMS error against the sound itself, relative to its own RMS."""
    stored = encode(x, rate, how, identity)
    back = render(stored, rate, len(x))
    rms = np.sqrt((x**2).mean())
    return stored.stored_bytes, float(np.sqrt(((x - back) ** 2).mean()) / rms) if rms > 0 else 0.0
