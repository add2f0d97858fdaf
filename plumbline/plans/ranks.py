"""Ranks within groups that may be arbitrarily large, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gapless_rank(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... within each `group`, in the order of `bucket` and then `order`.

    A group is cut into buckets (spread by a hash, say), so that a group with a third of all rows is
    ranked by many tasks: rows are numbered inside each (group, bucket), and the numbers of rows in the
    buckets before are added. Only one row per bucket meets in the window over the whole group.
    Rows that tie in `order` must be alike in all that follows from the rank.
    """
    keyed = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_start", "_inside")
    )


def buckets_for(rows: int, per_bucket: int) -> int:
    """How many buckets hold `rows` rows at about `per_bucket` each."""
    return max(1, -(-rows // per_bucket))
