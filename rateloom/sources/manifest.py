"""Note manifests: JSON in, samples joined to their recordings, and the sink of a consumed subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """settings STRUCT<rolls: STRUCT<pre_roll_seconds: DOUBLE, post_roll_seconds: DOUBLE>>, render STRUCT<tempo_bpm: DOUBLE>,
notes ARRAY<STRUCT<pitch: INT, velocity: INT, cc_averages: MAP<STRING, DOUBLE>, source_id: INT, render: STRUCT<index: INT, start_seconds: DOUBLE, release_end_seconds: DOUBLE>>>"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per note: index, pitch, velocity, controllers, start, duration, lead-in, trail bound, tempo. Unknown fields are ignored."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    notes = doc.select(F.col("settings.rolls").alias("rolls"), F.col("render.tempo_bpm").alias("tempo_bpm"), F.explode("notes").alias("n"))
    start, end = F.col("n.render.start_seconds"), F.col("n.render.release_end_seconds")
    return notes.select(
        F.col("n.render.index").alias("index"), F.col("n.pitch").alias("pitch"), F.col("n.velocity").alias("velocity"), F.col("n.cc_averages").alias("cc_averages"),
        start.alias("start_s"), (end - start).alias("duration_s"), F.least(F.coalesce("rolls.pre_roll_seconds", F.lit(0.0)), start).alias("lead_in_s"),
        F.coalesce("rolls.post_roll_seconds", F.lit(0.0)).alias("post_roll_s"), "tempo_bpm")


def load_notes(notes: DataFrame, takes: DataFrame) -> DataFrame:
    """Notes with their recordings. A note without one fails the job when it is read."""
    found = notes.join(takes.drop("pitch", "velocity", "cc_averages"), "index", "left")
    file = F.when(F.col("file").isNull(), F.raise_error(F.concat(F.lit("no recording for note "), F.col("index").cast("string")))).otherwise(F.col("file"))
    recorded = F.col("frames") / F.col("rate")
    trail = F.greatest(F.lit(0.0), F.least(recorded - F.col("lead_in_s") - F.col("duration_s"), F.col("post_roll_s")))
    return found.withColumn("file", file).withColumn("trail_out_s", trail)


def dump_notes(notes: DataFrame, path: str) -> None:
    """One JSON document of the notes, each over its own window with no rolls."""
    note = F.struct("pitch", "velocity", "cc_averages", F.struct(F.col("index"), F.lit(0.0).alias("start_seconds"), F.col("duration_s").alias("release_end_seconds")).alias("render"))
    rolls = F.struct(F.struct(F.lit(0.0).alias("pre_roll_seconds"), F.lit(0.0).alias("post_roll_seconds")).alias("rolls"))
    doc = notes.groupBy().agg(F.array_sort(F.collect_list(F.struct("index", F.to_json(note).alias("n")))).alias("all"))
    body = F.concat(F.lit('{"settings":'), F.to_json(rolls), F.lit(',"notes":['), F.array_join(F.transform("all", lambda x: x["n"]), ","), F.lit("]}"))
    doc.select(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)
