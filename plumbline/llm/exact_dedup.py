"""Exact deduplication by a tree merge of sorted digest runs. DataFrame operations only.

Level 0: the rows of one input partition (of several, if there are more than `max_runs`; a part of it, where there are fewer than `min_runs`) are a
run, with one row per digest. A run is cut into slices by its digests' hash, and each slice lies in one file, in the order of the digests. In each
binomial round every second run is exchanged with its neighbour: a task opens the same slice of both and
merges them in one pass over the two sorted files, without another shuffle or sort of its input. Rows that agree in
digest, byte length and a second fingerprint become one, which keeps the identifier that stays and adds up the counts. After
log2(runs) rounds one run is left. A slice is never more than a part of the digest space, so that not even the last run
lies in one task; and since a run holds a digest once, a text that fills a third of the corpus reaches a round as one row per run.

Spark plans no order for the result of an outer join, so it checks each written slice's order once more by a sort of
data that is in order already.

Nulls count as empty texts, so null and empty texts are equal. Texts of any length become one digest row. Of rows with equal
texts *and* equal identifiers one stays (whichever was read first). Null identifiers lose to all others. Other columns are
ignored by `exact_dedup` and kept by `drop_copies`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import ascii_lower
from plumbline.plans.lookup import join_facts
from plumbline.plans.storage import Scratch

_SAME = ["digest", "n_bytes", "second"]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, lower: bool) -> DataFrame:
    """row, id, SHA-256 of the normalised text, its length in bytes, and an independent 64-bit fingerprint."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = docs.select(F.col(id_col).cast("long").alias("id"), (ascii_lower(text) if lower else text).alias("t"))
    return normal.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("second"),
    )


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Lets Spark rely on the order of bucket files, and join runs that are dealt by the digest alone where they lie."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def merged(level: DataFrame) -> DataFrame:
    """One round: each run on side 0 merged with its neighbour on side 1, slice by slice, in the order of the files."""
    left, right = (level.where(f"side = {s}").select("pair", *_SAME, F.col("best").alias(f"best_{s}"), F.col("n").alias(f"n_{s}")) for s in (0, 1))
    return left.join(right, ["pair", *_SAME], "full_outer").select(
        F.col("pair").alias("run"),
        *_SAME,
        F.greatest("best_0", "best_1").alias("best"),
        (F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))).alias("n"),
    )


def merge_runs(rows: DataFrame, runs: int, slices: int, scratch: Scratch) -> DataFrame:
    """One row per distinct text: digest, n_bytes, second, best (the struct that stays), n (its copies)."""
    best = F.max(F.struct("id", (-F.col("row")).alias("turn"))).alias("best")
    run = rows.groupBy("run", *_SAME).agg(best, F.count(F.lit(1)).alias("n"))
    if runs > 1:
        run = run.repartition(slices, "digest")
    level = 0
    try:
        with _sorted_scans(rows.sparkSession):
            while runs > 1:
                dealt = run.withColumns({"pair": F.expr("run div 2").cast("int"), "side": F.expr("run % 2")}).drop("run")
                table = scratch.bucketed(dealt, f"level-{level}", slices, "digest", ["pair", *_SAME], "side")
                scratch.drop(f"level-{level - 1}")
                run, runs, level = merged(table), -(-runs // 2), level + 1
            classes = scratch.table(run.drop("run"), "classes")
    finally:
        scratch.drop(*(f"level-{k}" for k in range(max(0, level - 2), level + 1)))  # the catalog's entries, too, if a round fails
    return classes


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True, max_runs: int = 64, min_runs: int = 4, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """One row per input row: row, id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the row with the largest identifier stays. The texts are read once; what is shuffled are
    digests. Beyond `max_runs` input partitions, several make one run; fewer than `min_runs` are cut into several each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    found = fingerprints(docs, id_col, text_col, lower).withColumn("part", F.spark_partition_id())
    rows = scratch.table(found, "rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()
    cut = max(1, -(-min_runs // (facts["last"] + 1)))  # a row's number ends with its place in its partition
    rows = rows.withColumn("run", ((F.col("part") * cut + F.col("row") % cut) % max_runs).cast("int"))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts["n"] // rows_per_slice))
    classes = merge_runs(rows, min(max_runs, (facts["last"] + 1) * cut), slices, scratch)
    return join_facts(rows, classes, _SAME, "n", facts["n"]).select(
        "row",
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == -F.col("best.turn")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True, broadcast_rows: int = 500_000, **options
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    A row that goes is found by its identifier and digest, so identifiers need not be unique. Copies are the smaller part,
    so it is they that are joined: broadcast up to `broadcast_rows` of them (about 50 MB), else shuffled. Of
    rows alike in identifier and text, which no join can tell apart, one is taken; only these are shuffled for it.
    """
    found = exact_dedup(docs, id_col, text_col, lower, **options).where("NOT kept")
    gone = Scratch(docs.sparkSession, "copies").table(found.select("id", "keep_id", F.unhex("text_sha256").alias("sha")), "gone")
    twins = F.col("id").eqNullSafe(F.col("keep_id"))
    counts = gone.agg(F.count(F.lit(1)).alias("rows"), F.count_if(twins).alias("twins")).first()
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(ascii_lower(text) if lower else text, 256))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), sha.alias("_sha"))
    small = counts["rows"] <= broadcast_rows

    def among(copies: DataFrame, how: str) -> DataFrame:
        copies = F.broadcast(copies) if small else copies
        return keyed.join(copies, keyed["_id"].eqNullSafe(copies["id"]) & (keyed["_sha"] == copies["sha"]), how)

    if not counts["twins"]:
        return among(gone, "left_anti").select("_row.*")
    # only rows that have a twin are dealt anew; those whose text another identifier keeps go altogether
    same = gone.where(twins).select("id", "sha").distinct()
    one = among(same, "left_semi").dropDuplicates(["_id", "_sha"])
    return among(gone.select("id", "sha"), "left_anti").select("_row.*").unionByName(one.select("_row.*"))
