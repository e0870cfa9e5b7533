"""Positions and running totals over an order that no single task may hold.

A window without a partition, or over one hot key, sorts everything in one task. Here the rows are
range-partitioned on their full order instead, each range numbers its own rows, and the offsets of
the ranges (one row per range and group) are summed and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.session import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    # Both passes below must see the same ranges, also when a task is run again.
    return cut(ranged)


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``groups``, rows taken by ``order`` (a unique order)."""
    ranged = _ranged(df, [*groups, *order])
    keys = ["_range", *groups]
    local = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # At most one row per range and group, so even a global running sum windows over few rows here.
    offsets = (
        ranged.groupBy(*keys).agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    )
    return (
        ranged.withColumn(out, F.sum(value).over(local))
        .join(offsets, keys)
        .withColumn(out, F.col(out) + F.col("_offset")).drop("_range", "_offset")
    )


def positions(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position of each row within its group, safe for a group that holds most of the rows."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), groups, order, "_one", out).drop("_one")
