"""Levels over time: piecewise-linear dB curves and their algebra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rateloom.functions import kernels


@dataclass(frozen=True)
class Level:
    """dB at rising seconds; linear between them, constant beyond. clock: 'recorded' or 'played'."""

    seconds: tuple[float, ...]
    values: tuple[float, ...]
    clock: str = "recorded"

    def db(self, at) -> np.ndarray:
        return np.interp(at, self.seconds, self.values)

    def _joined(self, other: "Level", sign: float) -> "Level":
        if self.clock != other.clock:
            raise ValueError("levels of different clocks")
        grid = np.union1d(self.seconds, other.seconds)
        return Level(tuple(grid.tolist()), tuple((self.db(grid) + sign * other.db(grid)).tolist()), self.clock)

    def times(self, other: "Level") -> "Level":
        """Product of gains: dB add up."""
        return self._joined(other, 1.0)

    def over(self, other: "Level") -> "Level":
        return self._joined(other, -1.0)

    def scaled(self, db: float) -> "Level":
        return Level(self.seconds, tuple(v + db for v in self.values), self.clock)

    def at_pitch(self, semitones: float) -> "Level":
        """As heard when the recording plays faster by so many semitones."""
        if self.clock == "played":
            raise ValueError("the level is on the played clock already")
        ratio = 2 ** (semitones / 12)
        return Level(tuple(s / ratio for s in self.seconds), self.values, "played")

    def fitted(self, corners: int) -> "Level":
        knots, values = kernels.piecewise_fit(np.array(self.seconds), np.array(self.values), corners)
        return Level(tuple(knots.tolist()), tuple(values.tolist()), self.clock)

    def distance(self, other: "Level") -> float:
        return float(np.abs(self.over(other).values).max())

    def gains(self, frames: int, rate: float) -> np.ndarray:
        return 10 ** (self.db(np.arange(frames) / rate) / 20)

    @property
    def peak(self) -> float:
        return max(self.values)


def product(levels: list[Level]) -> Level:
    if not levels:
        raise ValueError("no levels")
    out = levels[0]
    for level in levels[1:]:
        out = out.times(level)
    return out


def constant(db: float, clock: str = "recorded") -> Level:
    return Level((0.0,), (db,), clock)


def read(signal: np.ndarray, rate: float, window_s: float = 0.05, most: int = 2048) -> Level:
    """RMS readings in dB at window centers; the window grows so that there are at most so many; a tail is dropped."""
    n = max(1, round(max(window_s, len(signal) / rate / most) * rate))
    count = len(signal) // n
    if not count:
        return constant(10 * float(np.log10((signal**2).mean() + 1e-12)) if len(signal) else -120.0)
    power = (signal[: count * n].reshape(count, n) ** 2).mean(axis=1)
    return Level(tuple(((np.arange(count) + 0.5) * n / rate).tolist()), tuple((10 * np.log10(power + 1e-12)).tolist()))


def trend(level: Level) -> tuple[float, float] | None:
    """Slope and intercept of the least-squares line; none under two readings."""
    if len(level.seconds) < 2:
        return None
    slope, intercept = np.polyfit(level.seconds, level.values, 1)
    return float(slope), float(intercept)


def envelope(level: Level, reference_db: float, ticks_per_s: float, ticks: int, points: int = 12, steps: int = 64) -> list[tuple[int, int]]:
    """A curve as integer (tick, step) nodes: corners of a fit, then steps improved one by one, eight sweeps at most."""
    at = np.arange(ticks) / ticks_per_s
    want = 10 ** ((level.db(at) - reference_db) / 20) * steps
    fit = Level(tuple(at.tolist()), tuple(want.tolist())).fitted(points)
    nodes = np.unique(np.round(np.array(fit.seconds) * ticks_per_s).astype(int))
    values = np.clip(np.round(np.interp(nodes / ticks_per_s, fit.seconds, fit.values)), 0, steps).astype(int)
    tick = np.arange(ticks)
    error = lambda v: float(((np.interp(tick, nodes, v) - want) ** 2).sum())
    best = error(values)
    for _ in range(8):
        moved = False
        for k in range(len(values)):
            for step in (-1, 1):
                trial = values.copy()
                trial[k] = np.clip(trial[k] + step, 0, steps)
                if (e := error(trial)) < best - 1e-9:
                    values, best, moved = trial, e, True
        if not moved:
            break
    return list(zip(nodes.tolist(), values.tolist(), strict=True))


def played(nodes: list[tuple[int, int]], ticks: int, steps: int = 64, floor: int = 0) -> np.ndarray:
    """Gain per tick of an envelope, no quieter than the floor step."""
    return np.maximum(np.interp(np.arange(ticks), [t for t, _ in nodes], [v for _, v in nodes]), floor) / steps


def balanced_gains(amounts: list[float]) -> list[int]:
    """Integer gains 1..64, the largest 64."""
    top = max(amounts, default=0.0)
    return [max(1, round(64 * a / top)) if top > 0 else 64 for a in amounts]


def held_back(x: np.ndarray, ceiling: float, kernel: np.ndarray) -> np.ndarray:
    """Limiter: the local level stays at or under the ceiling."""
    level = kernels.local_level(x, kernel)
    return x * np.minimum(1.0, ceiling / np.maximum(level, 1e-12))
