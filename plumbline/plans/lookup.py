"""Joins of many rows with facts about their keys, when one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of `rows` with `facts`: one row for each value of `keys`, and in `weight` how many of the `total` rows have it.

    Fewer than `hot_keys` values can have more than total/hot_keys rows each, so these are broadcast, whatever the data's
    size; their rows stay where they are. The others are shuffled by key, and none of them is more than
    total/hot_keys rows. Keys must not be null.
    """
    bound = total // hot_keys
    hot = F.broadcast(facts.where(F.col(weight) > bound))
    dealt = rows.join(hot.select(*keys), list(keys), "left_anti").join(facts.where(F.col(weight) <= bound), list(keys))
    return rows.join(hot, list(keys)).unionByName(dealt)


def join_dealt(rows: DataFrame, facts: DataFrame, key: str, weights: DataFrame, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of `rows` with `facts` (one row for each `key`, too wide to broadcast), with hot keys dealt over many tasks.

    `weights` has the columns `key` and `count`: how many of the `total` rows have each value. The rows of a key with more
    than total/hot_keys are dealt over as many tasks as that share goes into them, and its fact is copied for each: at most
    twice `hot_keys` copies altogether. What is broadcast are the hot keys and their numbers of copies.
    """
    bound = max(1, total // hot_keys)
    hot = F.broadcast(weights.where(F.col("count") > bound).select(key, F.ceil(F.col("count") / bound).cast("int").alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("_copies")
    right = facts.join(hot, key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return left.join(right, [key, "_copy"]).drop("_copy")
