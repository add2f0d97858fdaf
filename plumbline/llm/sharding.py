"""Sharding by weighted rendezvous hashing.

Each record scores every shard with a hash of (record key, shard) and goes to the best one. A shard's score does not
depend on the others, so one more shard only takes records into itself, and a shard that goes away only
gives up its own. A shard's share is proportional to its weight: the score is -ln(u)/weight with u uniform in (0, 1),
and the least wins.

Records with equal keys go to the same shard. A null key counts as the text `null`. Null and empty texts have size 1 and CRC 0; texts
may be of any length. Slots of repeated rows, which tie in all, are dealt among them in any order. Columns other than the two named are
ignored, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import unit_hash
from plumbline.plans.ranks import buckets_for, gapless_rank

_ROWS_PER_BUCKET = 10_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a record key. Ties go to the shard with the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct((-F.log((unit_hash(key, F.lit(str(s))) + 0.5) / float(1 << 32)) / float(w)).alias("score"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return F.array_min(F.array(*scores))["shard"]


def shard_records(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown: Sequence[float] | None = None,
    key_col: str = "doc_id",
    text_col: str = "text",
    rows_per_bucket: int = _ROWS_PER_BUCKET,
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot (gapless within the shard) and grown_shard.

    `grown` are the weights after growth; by default one more shard of the mean weight. The records of a shard
    are numbered in buckets of their key's hash, so that no shard is ranked by one task. Only the key and three numbers
    are shuffled, not the texts.
    """
    grown = list(grown) if grown is not None else [*weights, sum(weights) / len(weights)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(key_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key_col), weights).alias("shard"),
        rendezvous(F.col(key_col), grown).alias("grown_shard"),
    )
    buckets = buckets_for(docs.count(), rows_per_bucket * len(weights))
    bucket = F.pmod(unit_hash(F.coalesce(F.col(key_col).cast("string"), F.lit("null"))), F.lit(buckets))
    order = [F.col(key_col).asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    ranked = gapless_rank(rows, ["shard"], bucket, order, "slot")
    return ranked.select(key_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
