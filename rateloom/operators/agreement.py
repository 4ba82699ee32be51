"""Agreement statistics from counts: rank correlations without pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateloom.operators.relational import running_total


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b. Rows collapse to counts of (x, y); x should have few values, y may have many."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("x").orderBy("y")
    levels = cells.select("x").distinct()
    # for each y and each level of x the rows of that level below y
    grid = cells.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("here"))
    spread = grid.crossJoin(F.broadcast(levels)).select("y", "x", F.coalesce(F.element_at("here", F.col("x")), F.lit(0)).alias("n"))
    below = spread.withColumn("below", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    upper = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    met = upper.join(below, (F.col("y2") == F.col("y")) & (F.col("x") < F.col("x2")))
    concordant = met.agg(F.coalesce(F.sum(F.col("n2") * F.coalesce("below", F.lit(0))), F.lit(0)).alias("c"))
    pairs = lambda n: n * (n - 1) / 2
    tied_both = cells.agg(F.sum("n").alias("rows"), F.sum(pairs(F.col("n"))).alias("xy"))
    tied_x = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("tx"))
    tied_y = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ty"))
    one = concordant.crossJoin(tied_both).crossJoin(tied_x).crossJoin(tied_y)  # single rows
    total = pairs(F.col("rows"))
    discordant = total - F.col("tx") - F.col("ty") + F.col("xy") - F.col("c")
    scale = F.sqrt((total - F.col("tx")) * (total - F.col("ty")))
    return one.select(((F.col("c") - discordant) / F.nullif(scale, F.lit(0.0))).alias("tau"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of mean ranks. Ranks come from counts of distinct values, so ties need no order."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))

    def ranks(c: str) -> DataFrame:
        n = running_total(rows.groupBy(c).agg(F.count("*").alias("k")), c, "k", "upto")
        return n.select(c, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r{c}"))

    both = rows.join(ranks("x"), "x").join(ranks("y"), "y")
    a, b, n = F.col("rx"), F.col("ry"), F.count("*")
    cov = F.sum(a * b) / n - F.sum(a) / n * F.sum(b) / n
    var = lambda c: F.sum(c * c) / n - F.sum(c) / n * F.sum(c) / n
    return both.agg((cov / F.nullif(F.sqrt(var(a) * var(b)), F.lit(0.0))).alias("rho"))
