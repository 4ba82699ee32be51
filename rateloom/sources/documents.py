"""Small documents: JSON without non-finite numbers, label sheets, deterministic containers."""

from __future__ import annotations

import io
import json
import math
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The verdict tokens of a label sheet with their signed strength, the fault tokens, and the header.
VERDICTS = {"aa": 2, "a": 1, "tie": 0, "same": 0, "b": -1, "bb": -2}
FAULTS = ["hiss", "dull", "flutter", "beating", "click", "stop", "other"]
SHEET = ["directory", "verdict", "fault", "note"]


def json_safe(value):
    """Numbers of any kind as plain ones, non-finite ones as null, mappings and sequences throughout."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [json_safe(v) for v in (value.tolist() if hasattr(value, "tolist") else value)]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def json_text(value) -> str:
    return json.dumps(json_safe(value), indent=2, ensure_ascii=False) + "\n"


def container(entries: dict[str, bytes]) -> bytes:
    """A zip file that depends on its entries alone: fixed time and mode, names in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(entries):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, entries[name])
    return out.getvalue()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet with its strength; unknown tokens fail the job."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(", ".join(f"{c} STRING" for c in SHEET)).csv(path)
    verdict, fault = F.coalesce("verdict", F.lit("")), F.coalesce("fault", F.lit(""))
    known = verdict.isin("", *VERDICTS) & fault.isin("", *FAULTS)
    strength = F.element_at(F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair)), F.nullif(verdict, F.lit("")))
    checked = F.when(known, verdict).otherwise(F.raise_error(F.concat(F.lit("unknown label of "), F.col("directory"))))
    return rows.select("directory", checked.alias("verdict"), fault.alias("fault"), F.coalesce("note", F.lit("")).alias("note"), strength.alias("strength"))


def write_labels(rows: DataFrame, path: str) -> None:
    rows.select(*SHEET).coalesce(1).sortWithinPartitions("directory").write.mode("overwrite").option("header", True).csv(path)


def blank_sheet(pairs: DataFrame) -> DataFrame:
    """One open row for each directory."""
    return pairs.select("directory").distinct().select("directory", *(F.lit("").alias(c) for c in SHEET[1:]))
