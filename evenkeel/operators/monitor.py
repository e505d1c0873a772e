"""Counts and states of running jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def consumer_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Messages not yet read: the sum of end minus committed where it is ahead."""
    done = committed.select("topic", "partition", F.col("offset").alias("__done"))
    behind = F.greatest(F.col("offset") - F.col("__done"), F.lit(0))
    return ends.join(done, ["topic", "partition"], "inner").agg(
        F.coalesce(F.sum(behind), F.lit(0)).cast("long").alias("lag"))


def snapshot_progress(source: DataFrame | int, target: DataFrame) -> DataFrame:
    """Percent copied and whether the copy is complete. A source count of -1 is unknown."""
    counts = target.agg(F.count(F.lit(1)).alias("target_count"))
    if isinstance(source, DataFrame):
        none = F.lit(0).cast("long")
        counts = counts.select("target_count", none.alias("source_count")).unionByName(
            source.agg(F.count(F.lit(1)).alias("source_count")).select(none.alias("target_count"), "source_count")
        ).agg(F.sum("target_count").alias("target_count"), F.sum("source_count").alias("source_count"))
    else:
        counts = counts.withColumn("source_count", F.lit(source).cast("long"))
    s, t = F.col("source_count"), F.col("target_count")
    return counts.select(
        "source_count", "target_count",
        F.when(s > 0, F.round(F.least(F.lit(100.0), t / s * 100), 2)).otherwise(F.lit(0.0)).alias("percent"),
        F.when(s >= 0, t >= s).otherwise(t > 0).alias("complete"))


def delivery_summary(log: DataFrame, by: Sequence[str] = ("run_id",), ok: str = "sent") -> DataFrame:
    """Rows, sent and failed per run, and SUCCESS, PARTIAL or FAILED."""
    totals = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(ok)).alias("sent_count"))
    totals = totals.withColumn("failed_count", F.col("row_count") - F.col("sent_count"))
    return totals.withColumn("state", F.when(F.col("failed_count") == 0, "SUCCESS")
                             .when(F.col("sent_count") > 0, "PARTIAL").otherwise("FAILED"))
