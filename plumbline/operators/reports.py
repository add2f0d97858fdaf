"""Reports on answers and items: composition tables, stratified accuracy, gaps, agreement, screens.

Inputs are answers with items attached (model_id, item_id, label, y, grp, category, truth) or items themselves. All reduce
rows with partial aggregation before anything is joined or pivoted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("benign", "malignant", "refusal", "unparseable")


def contingency(items: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """A cross-table of counts with a `Total` row and column; levels of `col` are named, so no pass looks for them."""
    cube = items.groupBy(F.col(row).cast("string").alias("_r"), F.col(col).cast("string").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    total = cube.cube("_r", "_c").agg(F.sum("n").alias("n"), F.grouping("_r").alias("gr"), F.grouping("_c").alias("gc"))
    named = total.select(F.when(F.col("gr") == 1, "Total").otherwise(F.col("_r")).alias(row), F.when(F.col("gc") == 1, "Total").otherwise(F.col("_c")).alias("_c"), "n")
    wide = named.groupBy(row).pivot("_c", [*levels, "Total"]).agg(F.first("n"))
    return wide.fillna(0, [*levels, "Total"])


def base_rate(items: DataFrame) -> DataFrame:
    """Share of true items by group."""
    return items.groupBy("grp").agg(F.avg(F.col("truth").cast("int")).alias("base_rate"), F.count(F.lit(1)).alias("n_items"))


def stratified_accuracy(answers: DataFrame) -> DataFrame:
    """By respondent and group: accuracy over answered rows, and how many were answered, refused and asked."""
    return answers.groupBy("model_id", "grp").agg(
        F.avg("y").alias("accuracy"), F.count("y").alias("n_answered"), F.count_if(F.col("label") == "refusal").alias("n_refused"), F.count(F.lit(1)).alias("n_total")
    )


def accuracy_gap(accuracy: DataFrame, focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    """Per respondent, focal minus reference accuracy."""
    at = lambda g: F.max(F.when(F.col("grp") == g, F.col("accuracy")))
    return accuracy.groupBy("model_id").agg((at(focal) - at(reference)).alias("gap"))


def pooled_macro_accuracy(accuracy: DataFrame) -> DataFrame:
    """By group, the mean over respondents of their accuracy; respondents without answers are left out."""
    return accuracy.groupBy("grp").agg(F.avg("accuracy").alias("accuracy"), F.count("accuracy").alias("n_models"))


def pooled_gap(accuracy: DataFrame, focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    pooled = pooled_macro_accuracy(accuracy)
    at = lambda g: F.max(F.when(F.col("grp") == g, F.col("accuracy")))
    return pooled.agg(at(focal).alias("focal"), at(reference).alias("reference"), (at(focal) - at(reference)).alias("gap"))


def accuracy_wide(answers: DataFrame, groups: Sequence[str], focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    """One row per respondent: accuracy, share predicted positive and answers by group, rounded to 3; the gap of the rounded accuracies."""
    answered = answers.where("y IS NOT NULL").groupBy("model_id", "grp").agg(
        F.avg("y").alias("acc"), F.avg((F.col("label") == "malignant").cast("int")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    at = lambda c, g: F.max(F.when(F.col("grp") == g, F.col(c)))
    columns = []
    for g in groups:
        columns += [F.bround(at("acc", g), 3).alias(f"acc_{g}"), F.bround(at("pos", g), 3).alias(f"pred_mal_{g}"), F.coalesce(at("n", g), F.lit(0)).alias(f"n_{g}")]
    wide = answered.groupBy("model_id").agg(*columns)
    return wide.withColumn("gap", F.bround(F.col(f"`acc_{focal}`") - F.col(f"`acc_{reference}`"), 3))


def prediction_distribution(answers: DataFrame, min_coverage: int = 600) -> DataFrame:
    """By respondent, group and label the share of answers, beside the group's true share; respondents with few rows are dropped."""
    counts = answers.groupBy("model_id", "grp", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("truth").cast("int")).alias("t"))
    enough = counts.groupBy("model_id").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_coverage).select("model_id")
    at = lambda name: F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(0)) / F.sum("n")
    return (
        counts.join(F.broadcast(enough), "model_id", "left_semi")
        .groupBy("model_id", "grp")
        .agg(*[at(name).alias(name) for name in LABELS], F.sum("n").alias("n"), (F.sum("t") / F.sum("n")).alias("true_share"))
    )


def refusal_rate(cells: DataFrame, items: DataFrame, registry: DataFrame) -> DataFrame:
    """By respondent and group the share of refused items among all items of the group, asked or not; NULL model_id: all respondents."""
    sizes = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n_items"))
    refused = cells.where("refused").join(items.select("item_id", "grp"), "item_id").groupBy("model_id", "grp").agg(F.count(F.lit(1)).alias("n"))
    panel = registry.select(F.col("id").alias("model_id")).crossJoin(sizes)  # respondents by groups: a settings list by a handful
    full = panel.join(refused, ["model_id", "grp"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rolled = full.groupBy("grp", "model_id").agg(F.sum("n").alias("n_refused"), F.sum("n_items").alias("n_items"))
    overall = full.groupBy("grp").agg(F.sum("n").alias("n_refused"), F.sum("n_items").alias("n_items")).select("grp", F.lit(None).cast("string").alias("model_id"), "n_refused", "n_items")
    return rolled.unionByName(overall).withColumn("refusal_rate", F.col("n_refused") / F.col("n_items"))


def shared_levels(items: DataFrame, col: str, group_a: str, group_b: str) -> DataFrame:
    """Levels that occur in both groups."""
    return items.where(F.col("grp") == group_a).select(col).intersect(items.where(F.col("grp") == group_b).select(col))


def exclusive_levels(items: DataFrame, col: str, group_a: str, group_b: str) -> DataFrame:
    """Levels that occur in one of the two groups only, and in which."""
    a, b = (items.where(F.col("grp") == g).select(col) for g in (group_a, group_b))
    return a.subtract(b).withColumn("grp", F.lit(group_a)).union(b.subtract(a).withColumn("grp", F.lit(group_b)))


def mode_level(df: DataFrame, col: str) -> DataFrame:
    """The most frequent level; of equal ones the first by name."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(1)


def matched_gap(answers: DataFrame, focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    """Accuracy and items of two groups over the categories that both have answers in; the matched and the unmatched gap.

    Rows are reduced to items first, so distinct items need no second pass. A group without rows has no accuracy.
    """
    answered = answers.where(F.col("y").isNotNull() & F.col("grp").isin(focal, reference))
    by_item = answered.groupBy("grp", "category", "item_id").agg(F.sum("y").alias("right"), F.count(F.lit(1)).alias("n"))
    by_category = by_item.groupBy("grp", "category").agg(F.sum("right").alias("right"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
    both = by_category.groupBy("category").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("category", F.lit(True).alias("matched"))
    marked = by_category.join(both, "category", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    of = lambda g, c: F.sum(F.when((F.col("grp") == g) & F.col("matched"), F.col(c)))
    all_of = lambda g, c: F.sum(F.when(F.col("grp") == g, F.col(c)))
    return marked.agg(
        F.count_distinct(F.when(F.col("matched"), F.col("category"))).alias("n_categories"),
        (of(focal, "right") / of(focal, "n")).alias("acc_focal"),
        (of(reference, "right") / of(reference, "n")).alias("acc_reference"),
        of(focal, "items").alias("n_items_focal"),
        of(reference, "items").alias("n_items_reference"),
        (of(focal, "right") / of(focal, "n") - of(reference, "right") / of(reference, "n")).alias("matched_gap"),
        (all_of(focal, "right") / all_of(focal, "n") - all_of(reference, "right") / all_of(reference, "n")).alias("unmatched_gap"),
    )


def _planes(batch: pa.RecordBatch, name: str, first: int, words: int) -> np.ndarray:
    """Bit planes: a row for each respondent of a block, a bit for each item, in words of 64."""
    lists = batch.column("word")
    item = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    word, bits = lists.flatten().to_numpy() - first, batch.column(name).flatten().to_numpy()
    own = (word >= 0) & (word < words)
    rows = np.zeros((-(-batch.num_rows // 64) * 64, words), np.int64)
    rows[item[own], word[own]] = bits[own]
    by_respondent = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(by_respondent, axis=0, bitorder="little").T).view(np.uint64)


def _agreements(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Per pair of respondents of one pair of blocks: answers in common, equal ones, and each one's positive ones, by population counts."""
    current, sums = None, None

    def counted() -> Iterator[pa.RecordBatch]:
        (a, b), (n, a1, b1, both) = current, sums
        i, j = np.nonzero(n)
        keep = i + a * words * 64 < j + b * words * 64
        i, j = i[keep], j[keep]
        columns = [i + a * words * 64, j + b * words * 64, *(x[i, j] for x in (n, n - a1 - b1 + 2 * both, a1, b1))]
        for lo in range(0, len(i), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000].astype(np.int64)) for c in columns], ["a", "b", "n", "agree", "a1", "b1"])

    for batch in batches:
        blocks = np.stack([batch.column(c).to_numpy() for c in ("block_a", "block_b")])
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            part, pair = batch.slice(lo, hi - lo), tuple(blocks[:, lo].tolist())
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(c)]) for c in ("word", "asked", "positive")], ["word", "asked", "positive"])
            if pair != current:
                if current is not None:
                    yield from counted()
                current, sums = pair, [np.zeros((words * 64, words * 64), np.int64) for _ in range(4)]
            (xa, pa_), (xb, pb) = ([_planes(part, c, block * words, words) for c in ("asked", "positive")] for block in pair)
            for i in np.flatnonzero(xa.any(1)):
                for total, (left, right) in zip(sums, ((xa[i], xb), (pa_[i], xb), (xa[i], pb), (pa_[i], pb)), strict=True):
                    total[i] += np.bitwise_count(left & right).sum(1, dtype=np.int64)
    if current is not None:
        yield from counted()


def kappa_matrix(answers: DataFrame, block: int = 1024) -> DataFrame:
    """Cohen's kappa of the predicted labels of each two respondents over the items that both answered.

    An item's answers are bits, 64 respondents to a word, set by an aggregation; a task turns its items' words into bit planes of
    the respondents and counts common bits, for one pair of blocks of respondents at a time. What is shuffled are those words,
    and sums by pair and task, never pairs by item.
    """
    spark = answers.sparkSession
    known = answers.where("y IS NOT NULL")
    models = [r[0] for r in known.select("model_id").distinct().orderBy("model_id").collect()]
    panel = F.broadcast(spark.createDataFrame(list(enumerate(models)), "j int, model_id string"))
    words = max(1, min(-(-block // 64), -(-len(models) // 64)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j") % 64)
    word = F.expr("j div 64").cast("int")
    by_word = known.join(panel, "model_id").groupBy("item_id", word.alias("word")).agg(F.bit_or(bit).alias("asked"), F.bit_or(F.when(F.col("label") == "malignant", bit).otherwise(F.lit(0).cast("long"))).alias("positive"))
    blocks = max(1, -(-len(models) // (words * 64)))
    if blocks == 1 and words == 1:
        rows = by_word.select(F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), *[F.array(c).alias(c) for c in ("word", "asked", "positive")])
    else:
        packed = by_word.groupBy("item_id").agg(F.collect_list(F.struct("word", "asked", "positive")).alias("w"))
        pairs = F.lit([i * blocks + k for i in range(blocks) for k in range(i, blocks)])
        dealt = packed.withColumn("pair", F.explode(pairs)).select("item_id", "w", F.expr(f"pair div {blocks}").cast("int").alias("block_a"), F.expr(f"pair % {blocks}").cast("int").alias("block_b"))
        if blocks > 1:
            of_pair = F.filter("w", lambda x: (F.floor(x["word"] / words) == F.col("block_a")) | (F.floor(x["word"] / words) == F.col("block_b")))
            dealt = dealt.withColumn("w", of_pair).repartition("block_a", "block_b", F.pmod(F.xxhash64("item_id"), F.lit(64))).sortWithinPartitions("block_a", "block_b")
        rows = dealt.select("block_a", "block_b", *[F.col(f"w.{c}").alias(c) for c in ("word", "asked", "positive")])
    counted = rows.mapInArrow(partial(_agreements, words=words), "a long, b long, n long, agree long, a1 long, b1 long").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "agree", "a1", "b1")])
    for side in ("a", "b"):
        counted = counted.join(panel.withColumnsRenamed({"j": side, "model_id": f"model_{side}"}), side)
    expected = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
    observed = F.col("agree") / F.col("n")
    return counted.select("model_a", "model_b", "n", F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))


def degeneracy_screen(answers: DataFrame, kappa: DataFrame, majority: float = 0.95, agreement: float = 0.8) -> DataFrame:
    """Per respondent: shares of positive and of the more frequent answers, the greatest kappa with another respondent,
    and the ability that always answering that way would show; flagged if one of them is beyond its bound."""
    shares = answers.where("y IS NOT NULL").groupBy("model_id").agg(
        F.avg((F.col("label") == "malignant").cast("int")).alias("positive_share"), F.avg(F.col("truth").cast("int")).alias("base")
    )
    sides = kappa.select(F.col("model_a").alias("model_id"), "kappa").union(kappa.select("model_b", "kappa"))
    closest = sides.groupBy("model_id").agg(F.max("kappa").alias("max_kappa"))
    p = F.when(F.col("positive_share") >= 0.5, F.col("base")).otherwise(1 - F.col("base"))
    return (
        shares.join(closest, "model_id", "left")
        .withColumn("majority_share", F.greatest("positive_share", 1 - F.col("positive_share")))
        .withColumn("constant_ability", F.when((p > 0) & (p < 1), F.log(p / (1 - p))))
        .withColumn("flagged", (F.col("majority_share") >= majority) | F.coalesce(F.col("max_kappa") >= agreement, F.lit(False)))
        .drop("base")
    )


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Over repeated runs (delta, ci_low, ci_high, auc, decision): spread of delta, median width and AUC, and whether all decide alike."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        q("delta", 0.5).alias("median_delta"),
        F.min("delta").alias("min_delta"),
        F.max("delta").alias("max_delta"),
        (q("delta", 0.75) - q("delta", 0.25)).alias("iqr_delta"),
        q(F.col("ci_high") - F.col("ci_low"), 0.5).alias("median_ci_width"),
        q("auc", 0.5).alias("median_auc"),
        (F.count_distinct("decision") == 1).alias("all_same"),
    )


def fit_summary(item_fit: DataFrame, model_fit: DataFrame) -> DataFrame:
    """Population spread and range of difficulty, and spread of ability."""
    b = item_fit.agg(F.stddev_pop("b").alias("sd_b"), F.min("b").alias("min_b"), F.max("b").alias("max_b"))
    return b.crossJoin(model_fit.agg(F.stddev_pop("theta").alias("sd_theta")))  # one row by one row
