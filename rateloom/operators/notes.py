"""The note domain on DataFrames: screening, merging, bands and layers, velocity maps, budgets, nested documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateloom.functions import kernels
from rateloom.functions import scalars as S


def longest_by(notes: DataFrame, key: str, duration: str) -> DataFrame:
    return notes.groupBy(key).agg(F.max(duration).alias("longest"))


def screened(notes: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Notes that some recording answers, and the count of those lost for each key. Nothing left is an error for the caller."""
    have = keys.select(key).distinct()
    lost = notes.join(have, key, "left_anti").groupBy(key).agg(F.count("*").alias("lost"))
    return notes.join(have, key, "left_semi"), lost


def shortfalls(kept: DataFrame, length: str, required: str) -> DataFrame:
    """Kept recordings that run shorter than their material asks for."""
    return kept.where(F.col(length) < F.col(required))


def merged_events(notes: DataFrame, keys: list[str], duration: str, weight: str, ratio: float) -> DataFrame:
    """Notes of one identity and duration bucket as one event: weights add up, the longest edge stands for all."""
    edge = S.bucket_edge(F.col(duration), ratio)
    return notes.groupBy(*keys, edge.alias("bucket")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"), F.max(duration).alias("longest"))


def required_duration(longest: Column, half_span: float, least: float, most: float) -> Column:
    return F.greatest(F.least(longest * float(2 ** (half_span / 12)), F.lit(most)), F.lit(least))


def split_budget(module_bytes: int, file_bytes: int, instrument_bytes: int, instruments: int) -> int:
    """What is left for samples."""
    left = module_bytes - file_bytes - instrument_bytes * instruments
    if left <= 0:
        raise ValueError(f"the budget of {module_bytes} bytes holds no sample beside {instruments} instruments")
    return left


def velocity_volumes(anchors: dict[int, float], reference: int, floor_db: float = 48.0) -> list[int]:
    """128 volumes 0..64 from levels in dB at some velocities: interpolated, relative to the reference, floored."""
    known = {v: db for v, db in anchors.items() if np.isfinite(db)}
    if not known:
        return [0] * 128
    at = sorted(known)
    db = np.interp(np.arange(128), at, [known[v] for v in at])
    top = db[reference]
    gain = 10 ** ((np.maximum(db, top - floor_db) - top) / 20)
    return np.clip(np.round(gain * 64), 0, 64).astype(int).tolist()


def layered(cells: DataFrame, group: str, budget: int, most: int, min_gain: float) -> DataFrame:
    """Best split of each group's cells into layers.

    cells: group, cell (from 0), and points as array<struct<bytes long, loss double>>. Each band of a split stores one
    point of each of its cells' merged options; splits are tried fewest layers first and the least
    loss * (1 + min_gain)^(layers - 1) wins. Rows: group, layers, loss, bytes.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        options = [sorted((int(p["bytes"]), float(p["loss"])) for p in points) for points in pdf["points"]]
        n, best = len(options), None
        for mask in sorted(range(1 << (n - 1)), key=lambda m: (bin(m).count("1"), m)):
            if bin(mask).count("1") >= most:
                continue
            cuts = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
            bands = []
            for a, b in zip(cuts, cuts[1:]):
                # one stored sample serves the band: it costs what its cell's point costs, and every other cell loses more
                bands.append(kernels.lower_hull([(size, loss * (1 + (b - a - 1) * 0.5) * (b - a)) for k in range(a, b) for size, loss in options[k]]))
            found = kernels.mckp_exact([[(int(x), y) for x, y in band] for band in bands], budget)
            if found is None:
                continue
            score = found[0] * (1 + min_gain) ** (len(bands) - 1)
            if best is None or score < best[0] - 1e-12:
                best = (score, len(bands), found[0], sum(int(b[k][0]) for b, k in zip(bands, found[1], strict=True)))
        if best is None:
            return pd.DataFrame({group: [], "layers": [], "loss": [], "bytes": []})
        return pd.DataFrame({group: [pdf[group].iloc[0]], "layers": [best[1]], "loss": [best[2]], "bytes": [best[3]]})

    kind = cells.schema[group].dataType.simpleString()
    return cells.groupBy(group).applyInPandas(solve, f"{group} {kind}, layers int, loss double, bytes long")


def document(rows: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Nested JSON: a document for each key with its rows in order."""
    item = F.struct(*order, *(c for c in columns if c not in order))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return listed.select(*keys, F.to_json(F.struct(*keys, F.size("rows").alias("n"), "rows")).alias("document"))
