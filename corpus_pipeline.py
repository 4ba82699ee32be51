"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.

Helper columns never stand beside a document's own: filters take them as expressions, joins qualify them, and mixing
carries the document's columns in one struct. Further columns of any name and type go through; the last stage gives
the columns of its contract only. Null and empty texts, repeated rows and empty tables have the results that the
operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.llm import decontam, mixing, sharding, simhash, toxicity
from rateloom.session import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half."""
    score = toxicity.score_udf(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose fingerprints link them, or five-word shingles alike by four fifths."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each time a document is taken, n_chars as its text has them."""
    row = F.col("row")
    taken = mixing.mixed(docs, carry=True).select("row", F.explode(mixing.emitted(row["text"], F.col("spans"))).alias("words"))
    made = {"text": F.col("words"), "n_chars": F.length("words").cast("long")}
    return taken.select(*(made.get(c, row.getField(c)).alias(c) for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard, slot, size and checksum."""
    return sharding.sharded(docs).withColumn("law", F.lit("bytes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier and the fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage_{name}")
    return docs
