"""Settings in groups, read from a YAML tree; unknown names and values that contradict each other are refused."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Ingest:
    pre_roll_s: float = 0.0
    post_roll_s: float = 0.0
    default_velocity: int = 127


@dataclass(frozen=True)
class Budget:
    budget_kib: float = 512.0
    max_samples: int = 24
    max_layers: int = 3
    resolution: int | None = 65_536
    discard_penalty: float = 0.5


@dataclass(frozen=True)
class Sweep:
    rates: tuple[int, ...] = (8_000, 11_025, 16_000, 22_050, 32_000, 44_100)
    depths: tuple[int, ...] = (8, 16)
    rate_headroom: int = 1


@dataclass(frozen=True)
class Loop:
    seam_limit: float = 6.0
    drift_db: float = 6.0
    timbre_db: float = 18.0
    periods: int = 4


@dataclass(frozen=True)
class Settings:
    ingest: Ingest = field(default_factory=Ingest)
    budget: Budget = field(default_factory=Budget)
    sweep: Sweep = field(default_factory=Sweep)
    loop: Loop = field(default_factory=Loop)

    def __post_init__(self):
        if self.budget.budget_kib <= 0 or self.budget.max_layers < 1:
            raise ValueError("a budget needs bytes and a layer")
        if not self.sweep.rates or sorted(self.sweep.rates) != list(self.sweep.rates):
            raise ValueError("rates must rise")
        if not set(self.sweep.depths) <= {8, 16, 24}:
            raise ValueError("depths are 8, 16 or 24")


def build(kind, values: dict, where: str = "settings"):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown in {where}: {', '.join(sorted(unknown))}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None
        made[name] = build(type(default), value, f"{where}.{name}") if is_dataclass(default) else tuple(value) if isinstance(value, list) else value
    return kind(**made)


def load(folder: str | Path) -> Settings:
    """A group for each YAML file of the folder, named like it."""
    import yaml

    return build(Settings, {p.stem: yaml.safe_load(p.read_text()) or {} for p in sorted(Path(folder).glob("*.yaml"))})
