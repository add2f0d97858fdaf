"""Joins with facts of keys that hold a large part of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.plans.lookup import join_dealt, join_facts


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90).alias("k"), "id", F.lit("a").alias("name"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 11").withColumn("fact", F.col("k") * 2)
    return rows, facts, Counter((r.id, r.k * 2) for r in rows.collect() if r.k != 11)


@pytest.mark.parametrize("hot_keys", [1, 5, 40, 10_000])
def test_join_facts(tables, hot_keys):
    rows, facts, want = tables
    assert Counter((r.id, r.fact) for r in join_facts(rows, facts, ["k"], "n", 3000, hot_keys).collect()) == want


@pytest.mark.parametrize("hot_keys", [1, 5, 40, 10_000])
def test_join_dealt(tables, hot_keys):
    rows, facts, want = tables
    got = join_dealt(rows, facts.drop("n"), "k", rows.groupBy("k").count(), 3000, hot_keys)
    assert got.columns == ["k", "id", "name", "fact"] and Counter((r.id, r.fact) for r in got.collect()) == want
