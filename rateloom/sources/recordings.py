"""Folders of recordings: file names parsed as expressions, headers and samples of WAV files decoded in Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateloom.functions import scalars as S

HEADER = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("frames", T.LongType())])


def wav_chunks(data: bytes) -> tuple[int, int, int, int, bytes]:
    """(format, channels, rate, bits, samples) of a RIFF file; raises on anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if form[0] == 0xFFFE and size >= 26:  # extensible: the format stands in the subformat
                form = (struct.unpack("<H", data[at + 32 : at + 34])[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("a WAV file without a format")
    return form[0], form[1], form[2], form[5], body


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate; channels are averaged."""
    form, channels, rate, bits, body = wav_chunks(data)
    if form == 3:
        x = np.frombuffer(body, f"<f{bits // 8}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(body, "u1").astype(float) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], "u1").reshape(-1, 3).astype(np.int32)
        x = (((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    else:
        x = np.frombuffer(body, f"<i{bits // 8}").astype(float) / float(1 << (bits - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """A mono 32-bit float WAV file."""
    body = np.asarray(x, "<f4").tobytes()
    form = struct.pack("<HHIIHH", 3, 1, rate, rate * 4, 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


@F.pandas_udf(HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        _, channels, rate, bits, body = wav_chunks(data)
        rows.append((rate, channels, len(body) // (channels * bits // 8)))
    return pd.DataFrame(rows, columns=["rate", "channels", "frames"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def wav_samples(content: pd.Series) -> pd.Series:
    return pd.Series([decode_wav(data)[0].tolist() for data in content])


def recordings(spark: SparkSession, folder: str, samples: bool = False) -> DataFrame:
    """A row per WAV file: file, index, pitch, velocity, controllers, rate, channels, frames and, if asked for, samples.

    A pitch comes from a `p` token, else from a note name; velocities that are missing throughout are 127.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    parsed = files.select(name.alias("file"), wav_header("content").alias("h"), *([wav_samples("content").alias("samples")] if samples else []))
    tokens = F.split("file", "_")
    note = F.get(F.filter(F.transform(tokens, S.named_pitch), lambda p: p.isNotNull()), F.lit(0))
    ccs = F.map_from_entries(F.transform(
        F.filter(tokens, lambda t: F.rlike(t, F.lit(r"^cc\d+-\d+$"))),
        lambda t: F.struct(F.regexp_extract(t, r"^cc(\d+)-", 1).cast("int"), F.regexp_extract(t, r"-(\d+)$", 1).cast("double"))))
    rest = ["samples"] if samples else []
    return parsed.select(
        "file", F.nullif(F.regexp_extract("file", r"^(\d+)_", 1), F.lit("")).cast("int").alias("index"),
        F.coalesce(S.first_token(F.col("file"), "p"), note).alias("pitch"), S.first_token(F.col("file"), "v").alias("velocity"),
        ccs.alias("cc_averages"), "h.rate", "h.channels", "h.frames", *rest)


def resolved_velocities(takes: DataFrame) -> DataFrame:
    """All missing: 127. Missing on some only raises, as does a take without a pitch."""
    c = takes.agg(F.count("*").alias("n"), F.count("velocity").alias("v"), F.count("pitch").alias("p")).first()
    if not c["n"]:
        raise ValueError("no recordings")
    if c["p"] < c["n"]:
        raise ValueError("a recording without a pitch")
    if 0 < c["v"] < c["n"]:
        raise ValueError("velocities on some recordings only")
    return takes.withColumn("velocity", F.coalesce("velocity", F.lit(127)))
