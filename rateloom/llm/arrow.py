"""Column-wise Python over Arrow batches, and the word rules that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Letters A-Z become lower case, every other ASCII byte that is no digit or a-z becomes a blank.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def struct(fields: str | T.StructType) -> T.StructType:
    return fields if isinstance(fields, T.StructType) else T.StructType.fromDDL(fields)


def map_columns(df: DataFrame, fn: Callable[..., Iterable], fields: str | T.StructType) -> DataFrame:
    """Apply fn to the columns of each Arrow batch as lists; fn returns the output columns in the order of fields."""
    schema = struct(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            columns = fn(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at exactly these six bytes."""
    return encoded(text).split()


def lower_space_words(text: str | None) -> list[bytes]:
    """The same after A-Z became lower case; bytes.lower() leaves other characters alone."""
    return encoded(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became lower case."""
    return encoded(text).translate(ALNUM_TABLE).split()
