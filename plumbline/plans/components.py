"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lookup import join_facts
from plumbline.plans.storage import Scratch

#: Links from which a node may have too many neighbours for one task.
_HUB_LINKS = 100_000


def with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Links (u, v) with what `least` says of u (and k, how many links it has). A hub's links stay where they are: after some rounds all nodes
    of a component hang on one."""
    return links.join(least.drop("k"), "u") if total <= _HUB_LINKS else join_facts(links, least, ["u"], "k", total).drop("k")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("k"))
    return with_least(both, least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
    moved = with_least(down, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `links` (columns u, v); label is the least node that can be reached.

    Alternates large and small stars, which takes a number of rounds that grows with the logarithm of the longest path.
    Each round is a table, so a lost executor costs at most the round that runs.
    """
    edges = scratch.table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, kept, total = None, f"{name}-0", edges.count()
    if not total:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for i in range(1, max_rounds + 1):
        edges = scratch.table(_small_star(_large_star(edges, total), 2 * total), f"{name}-{i}")
        scratch.drop(kept)
        kept = f"{name}-{i}"
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, total = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v")).distinct())
