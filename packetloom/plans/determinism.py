"""Comparing two runs line by line without moving them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: lines in each, first differing event_id (null if none), its two lines."""
    both = one.toDF("event_id", "a").join(two.toDF("event_id", "b"), "event_id", "full_outer")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count("a").alias("lines_a"), F.count("b").alias("lines_b"), F.min(F.when(differs, F.col("event_id"))).alias("event_id"), F.min_by(F.struct("a", "b"), F.when(differs, F.col("event_id"))).alias("_x")).select("lines_a", "lines_b", "event_id", F.when(F.col("event_id").isNotNull(), F.col("_x.a")).alias("line_a"), F.when(F.col("event_id").isNotNull(), F.col("_x.b")).alias("line_b"))


def digest(lines: DataFrame) -> DataFrame:
    """One row that two equal streams share: the count and an order-free sum over hashed (event_id, line)."""
    h = F.conv(F.left(F.sha2(F.concat_ws("\n", F.col("event_id").cast("string"), "line"), 256), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("lines"), F.sum(h).cast("string").alias("digest"))
