"""Rate-distortion solvers over groups: exact choice and exact partition, with brute-force-checked kernels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from rateloom.functions import kernels


def exact_choice(options: DataFrame, group: str, item: str, cost: str, loss: str, budget: str) -> DataFrame:
    """For each group one option of every item within the group's budget at least loss. Rows: group, loss, bytes."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [list(map(tuple, p.sort_values([cost, loss])[[cost, loss]].values.tolist())) for _, p in pdf.groupby(item, sort=True)]
        items = [[(int(c), float(d)) for c, d in p] for p in items]
        found = kernels.mckp_exact(items, int(pdf[budget].iloc[0]))
        if found is None:
            return pd.DataFrame({group: [], "loss": [], "bytes": []})
        value, picks = found
        return pd.DataFrame({group: [pdf[group].iloc[0]], "loss": [value], "bytes": [sum(p[k][0] for p, k in zip(items, picks, strict=True))]})

    kind = options.schema[group].dataType.simpleString()
    return options.groupBy(group).applyInPandas(solve, f"{group} {kind}, loss double, bytes long")


def exact_partition(zones: DataFrame, group: str, budget: int, most: int | None = None, grid: int = 1) -> DataFrame:
    """zones: group, start, stop, bytes, loss with keys numbered from 0. Rows: group, loss, bytes, n_zones.

    grid: the byte steps in which the budget is walked; a group's table has (keys + 1) * budget / grid cells (times most).
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for a, b, size, loss in pdf.sort_values(["start", "stop", "bytes"])[["start", "stop", "bytes", "loss"]].values.tolist():
            table.setdefault((int(a), int(b)), []).append((int(size), float(loss)))
        found = kernels.partition_exact(int(pdf["stop"].max()) + 1, table, budget, most, grid)
        if found is None:
            return pd.DataFrame({group: [], "loss": [], "bytes": [], "n_zones": []})
        return pd.DataFrame({group: [pdf[group].iloc[0]], "loss": [found[0]], "bytes": [found[1]], "n_zones": [len(found[2])]})

    kind = zones.schema[group].dataType.simpleString()
    return zones.groupBy(group).applyInPandas(solve, f"{group} {kind}, loss double, bytes long, n_zones long")
