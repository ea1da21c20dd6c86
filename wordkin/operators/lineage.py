"""Merge times of lineages: ``lineage(lineage_id, i, time)`` with i = 0, 1, ... per lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def merge_gaps(lineage: DataFrame) -> DataFrame:
    """Time since the previous merge, by an equi join on the previous number.

    A window would hold one whole lineage in one task; the join spreads a long one.
    """
    before = lineage.select("lineage_id", (F.col("i") + 1).alias("i"), F.col("time").alias("_t"))
    return lineage.join(before, ["lineage_id", "i"], "left").select(
        "lineage_id", "i", "time", (F.col("time") - F.coalesce("_t", F.lit(0.0))).alias("gap")
    )


def log_likelihood(lineage: DataFrame) -> DataFrame:
    """log p = -sum((n-i)(n-i-1)/2 * gap_i) with n = merges + 1, and p itself.

    Summing by parts turns it into -sum(time_i * (merges - i)): no gaps, no order, one
    aggregate with map-side combine.
    """
    m = F.count("*").cast("double")
    return (
        lineage.groupBy("lineage_id")
        .agg((F.sum(F.col("time") * F.col("i")) - m * F.sum("time")).alias("log_p"), (F.count("*") + 1).alias("n"))
        .withColumn("p", F.exp("log_p"))
    )
