"""Prefix operations over long ordered groups.

A window over the whole group would run in one task. Here the order column is cut in
chunks: a window inside each chunk (at most ``chunk`` rows) and a second one over the
chunk summaries (group length / chunk rows), joined back on (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 65_536


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))


def running_total(
    df: DataFrame, key: list[str], order: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Sum of ``value`` over the strictly earlier rows of the group."""
    rows = _chunked(df.withColumn("_v", value), order, chunk)
    inside = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*key, "_chunk")
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_before", F.coalesce(F.sum("_t").over(across), F.lit(0)))
        .drop("_t")
    )
    return (
        rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(carry, key + ["_chunk"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_v", "_in", "_before", "_chunk")
    )


def fill_down(
    df: DataFrame, key: list[str], order: str, columns: list[str], chunk: int = CHUNK
) -> DataFrame:
    """Last non-null value at or before each row, for every named column."""
    rows = _chunked(df, order, chunk)
    inside = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.groupBy(*key, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_t_{c}") for c in columns]
    )
    carry = tails.select(
        *key,
        "_chunk",
        *[F.last(f"_t_{c}", ignorenulls=True).over(across).alias(f"_c_{c}") for c in columns],
    )
    filled = rows.join(carry, key + ["_chunk"])
    for c in columns:
        filled = filled.withColumn(
            c, F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}"))
        )
    return filled.drop("_chunk", *[f"_c_{c}" for c in columns])


def ranked(df: DataFrame, key: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """0-based rank in the group. ``bucket`` must be non-decreasing in the order columns."""
    rows = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*key, "_b").orderBy(*order)
    across = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*key, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)))
        .drop("_n")
    )
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(carry, key + ["_b"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_b", "_in", "_before")
    )
