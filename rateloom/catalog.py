"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rateloom.plans import audio, fidelity, relations, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relations.QUERIES, **signals.QUERIES, **audio.QUERIES, **fidelity.QUERIES}
ORACLE_SQL: dict[str, str] = {**relations.SQL, **signals.SQL, **audio.SQL, **fidelity.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the identity dedupe, each part's prices, and the rate-distortion curve over brands."""
    return relations.lagrangian_curve(spark, sf_dir)
