"""Registry of fidelity metrics: a name stands for a factory of column functions (reference, candidate) -> distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rateloom.functions import arrays as A

Metric = Callable[[Column, Column], Column]
_FACTORIES: dict[str, Callable[[], Metric]] = {}


def register_metric(name: str, factory: Callable[[], Metric], overwrite: bool = False) -> None:
    if name in _FACTORIES and not overwrite:
        raise ValueError(f"a metric named {name} is registered already")
    _FACTORIES[name] = factory


def unregister_metric(name: str) -> None:
    _FACTORIES.pop(name, None)


def available_metrics() -> list[str]:
    return sorted(_FACTORIES)


def build_metric(name: str) -> Metric:
    if name not in _FACTORIES:
        raise KeyError(f"no metric named {name}; there are {', '.join(available_metrics())}")
    return _FACTORIES[name]()


def build_composite(weights: dict[str, float]) -> Metric:
    """Weighted sum of registered metrics."""
    parts = [(w, build_metric(name)) for name, w in sorted(weights.items())]

    def score(ref: Column, cand: Column) -> Column:
        out = F.lit(0.0)
        for w, metric in parts:
            out = out + F.lit(float(w)) * metric(ref, cand)
        return out

    return score


register_metric("spectral_distance", lambda: A.distance)
register_metric("peak_delta", lambda: lambda a, b: F.abs(F.array_max(a) - F.array_max(b)))
register_metric("snr", lambda: lambda a, b: -A.snr(a, b))
register_metric("si_sdr", lambda: lambda a, b: -A.si_sdr(a, b))
register_metric("segmental_snr", lambda: lambda a, b: -A.segmental_snr(a, b, 16, -10.0, 35.0))
