"""Rank statistics, per-item tests and false-discovery control.

No window runs over a whole table: ranks come from counts per distinct value and their running totals over range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.kernels import chi_square_p, hash_draws, normal_two_sided_p, t_two_sided_p
from plumbline.plans.storage import Scratch

_BROADCAST_RANKS = 200_000


def running_total(counts: DataFrame, value: str, n: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `name`: the sum of `n` over all smaller values (within `keys`), for any number of distinct values.

    Values are dealt to ranges between quantiles; each range sums its own, and what the ranges before hold is added. The
    quantiles, some dozens of numbers, are fixed before, so that a range is the same wherever it is computed.
    """
    counts = Scratch(counts.sparkSession, "totals").table(counts, "counts")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = counts.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)] or [0.5])).first()[0] or []
    place = F.lit(0)
    if bounds:
        place = F.aggregate(F.lit(sorted(set(map(float, bounds)))), F.lit(0), lambda at, b: at + (F.col(value) > b).cast("int"))
    dealt = counts.withColumn("_p", place)
    own = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_in", F.coalesce(F.sum(n).over(own), F.lit(0)))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_p", *keys).agg(F.sum(n).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    # without keys, starts are as few as ranges
    starts = starts.hint("merge") if keys else F.broadcast(starts)
    return inside.join(starts, ["_p", *keys]).withColumn(name, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before")


def average_ranks(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the average rank of `value` (within `keys`): 1 for the least, the mean of their places for equal ones.

    Ranks of up to 200,000 distinct values are broadcast; more are joined by a merge. The rows never are: a file of millions of rows with few
    distinct values is of a size that Spark would broadcast.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_total(counts, value, "_n", "_b", keys).select(*keys, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name))
    ranks = Scratch(df.sparkSession, "ranks").table(ranks, "ranks")
    return df.join(F.broadcast(ranks) if ranks.count() <= _BROADCAST_RANKS else ranks.hint("merge"), [*keys, value])


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation; NULL if one side doesn't vary, where the built-in divides by zero."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho on average ranks and the two-sided p of its t statistic, over rows where both are there. NULL if one doesn't vary."""
    pairs = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    # ranks read their rows more than once, so what the rows come from is run only here
    pairs = Scratch(df.sparkSession, "spearman").table(pairs, "pairs")
    ranked = average_ranks(average_ranks(pairs, "x", "rx"), "y", "ry")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), _correlation("rx", "ry").alias("rho"))
    return out.withColumn("p", t_two_sided_p(F.col("rho"), F.col("n")))


def correlate_features(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Spearman of the target with each feature, the strongest first."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.selectExpr(f"CAST(`{target}` AS DOUBLE) AS x", f"stack({len(features)}, {pairs}) AS (feature, y)").where("x IS NOT NULL AND y IS NOT NULL")
    long = Scratch(df.sparkSession, "features").table(long, "long")
    ranked = average_ranks(average_ranks(long, "x", "rx", ["feature"]), "y", "ry", ["feature"])
    out = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), _correlation("rx", "ry").alias("rho"))
    return out.withColumn("p", t_two_sided_p(F.col("rho"), F.col("n"))).orderBy(F.abs("rho").desc_nulls_last(), "feature")


def lord_chi2(model_fit: DataFrame, focal: DataFrame, reference: DataFrame) -> DataFrame:
    """Per item, the squared difference of two groups' difficulties over its variance from the information at all abilities.

    Respondents (theta) are broadcast as one array: a settings list. Information is at least 1e-6.
    """
    thetas = F.broadcast(model_fit.agg(F.collect_list("theta").alias("thetas")))
    both = focal.select("item_id", F.col("b").alias("bf")).join(reference.select("item_id", F.col("b").alias("br")), "item_id").join(thetas)

    def information(b: str) -> Column:
        p = lambda t: 1 / (1 + F.exp(F.col(b) - t))
        return F.greatest(F.aggregate("thetas", F.lit(0.0), lambda s, t: s + p(t) * (1 - p(t))), F.lit(1e-6))

    chi2 = F.pow(F.col("bf") - F.col("br"), 2) / (1 / information("bf") + 1 / information("br"))
    return both.select("item_id", chi2.alias("chi2")).withColumn("p", chi_square_p(F.col("chi2")))


def mantel_haenszel(answers: DataFrame, pair: str, focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    """Per matched pair (a column of `answers`): delta = -2.35 ln(alpha) of the summed 2x2 table, its chi-square and p.

    NULL where the product of either diagonal is 0.
    """
    right, wrong = F.col("y"), 1 - F.col("y")
    of = lambda g, v: F.coalesce(F.sum(F.when(F.col("grp") == g, v)), F.lit(0)).cast("double")
    t = answers.where("y IS NOT NULL").groupBy(pair).agg(of(focal, right).alias("a"), of(focal, wrong).alias("b"), of(reference, right).alias("c"), of(reference, wrong).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    e = (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / n
    v = F.when(n > 1, (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d")) / (n * n * (n - 1))).otherwise(1.0)
    defined = (F.col("a") * F.col("d") > 0) & (F.col("b") * F.col("c") > 0)
    out = t.select(
        pair,
        F.when(defined, -2.35 * F.log(F.col("a") * F.col("d") / (F.col("b") * F.col("c")))).alias("delta"),
        F.when(defined, F.pow(F.col("a") - e, 2) / F.greatest(v, F.lit(1e-9))).alias("chi2"),
    )
    return out.withColumn("p", chi_square_p(F.col("chi2")))


def ability_bins(model_fit: DataFrame, bins: int = 5) -> DataFrame:
    """Each respondent's bin between linear quantiles of ability; the last edge is raised by 1e-6."""
    edges = F.broadcast(model_fit.agg(F.percentile("theta", F.lit([k / bins for k in range(1, bins)])).alias("edges")))
    return model_fit.join(edges).select("model_id", "theta", F.aggregate("edges", F.lit(0), lambda s, e: s + (F.col("theta") >= e).cast("int")).alias("bin"))


def bin_counts(bins: DataFrame, cells: DataFrame) -> DataFrame:
    """Per ability bin: its respondents, their answers and the right ones. bins: model_id, bin."""
    answered = cells.where("y IS NOT NULL").groupBy("model_id").agg(F.count("y").alias("n"), F.sum("y").alias("r"))
    joined = bins.join(answered, "model_id", "left")
    return joined.groupBy("bin").agg(F.count(F.lit(1)).alias("n_models"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("n_right"))


_DRAWS_AT_ONCE = 2_000_000
_MASKS_KEPT = 100_000


_dictionaries: dict[tuple[int, int, int, int], tuple[np.ndarray, np.ndarray]] = {}


def _drawn_masks(n: int, k: int, n_perm: int, seed: int, step: int) -> Iterator[np.ndarray]:
    for lo in range(0, n_perm, step):
        draws = hash_draws(seed, np.arange(lo, min(lo + step, n_perm)), np.arange(n))
        yield np.argsort(np.argsort(draws, axis=1, kind="stable"), axis=1, kind="stable") < k


def _masks(n: int, k: int, n_perm: int, seed: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The permuted masks with how often each is drawn. Where there are fewer masks than permutations (126 of nine respondents with four focal
    ones), a worker keeps them in a dictionary and each is evaluated once; else they are drawn in blocks and kept nowhere."""
    step = max(1, _DRAWS_AT_ONCE // max(n, rows))
    if n > 62 or math.comb(n, k) > min(n_perm, _MASKS_KEPT) / 2:
        for focal in _drawn_masks(n, k, n_perm, seed, step):
            yield focal, np.ones(len(focal), np.int64)
        return
    key = (n, k, n_perm, seed)
    if key not in _dictionaries:
        bits = np.concatenate([focal @ (1 << np.arange(n, dtype=np.int64)) for focal in _drawn_masks(n, k, n_perm, seed, step)])
        own, times = np.unique(bits, return_counts=True)
        if len(_dictionaries) >= 64:
            _dictionaries.clear()
        _dictionaries[key] = (own[:, None] >> np.arange(n)) & 1 == 1, times
    focal, times = _dictionaries[key]
    part = max(1, _DRAWS_AT_ONCE // max(1, rows))
    for lo in range(0, len(focal), part):
        yield focal[lo : lo + part], times[lo : lo + part]


def _permuted(frames: Iterator[pd.DataFrame], n_perm: int, seed: int) -> Iterator[pd.DataFrame]:
    """Items with as many answers and as many focal ones share their draws, which are made in blocks and kept nowhere."""
    for frame in frames:
        values, masks = [np.asarray(r, float) for r in frame["resid"]], [np.asarray(m, bool) for m in frame["mask"]]
        alike: dict[tuple[int, int], list[int]] = {}
        for i, m in enumerate(masks):
            if 0 < (k := int(m.sum())) < len(m):
                alike.setdefault((len(m), k), []).append(i)
        p = [None] * len(values)
        for (n, k), rows in alike.items():
            r, m = np.stack([values[i] for i in rows]), np.stack([masks[i] for i in rows])
            seen = np.abs((r * m).sum(1) / k - (r * ~m).sum(1) / (n - k))
            total, count = r.sum(1), np.zeros(len(rows), np.int64)
            for focal, times in _masks(n, k, n_perm, seed, len(rows)):
                own = focal.astype(float) @ r.T
                count += times @ (np.abs(own / k - (total - own) / (n - k)) >= seen - 1e-12)
            for i, c in zip(rows, count, strict=True):
                p[i] = (int(c) + 1) / (n_perm + 1)
        yield pd.DataFrame({"item_id": frame["item_id"], "permutation_p": pd.array(p, dtype="Float64")})


def permutation_test(residuals: DataFrame, n_perm: int = 10_000, seed: int = 0xDD5) -> DataFrame:
    """Per item, the share of permuted focal masks with as large a mean difference; NULL if one side is empty.

    residuals: model_id, item_id, resid, focal. An item's rows are as many as respondents. A permutation's focal
    respondents are those with the least hash draws of (seed, permutation, place in the order of respondents).
    """
    ordered = F.sort_array(F.collect_list(F.struct("model_id", "resid", "focal")))
    packed = residuals.groupBy("item_id").agg(ordered.alias("r")).select("item_id", F.col("r.resid").alias("resid"), F.col("r.focal").alias("mask"))
    return packed.mapInPandas(partial(_permuted, n_perm=n_perm, seed=seed), f"item_id {dict(residuals.dtypes)['item_id']}, permutation_p double")


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: float = 0.05) -> DataFrame:
    """Adds significant: whether the false discovery rate admits the row. NULL and NaN count in no way.

    Only values up to q can pass, and their ranks don't depend on the others; so those are counted, and the greatest that
    lies under its line decides.
    """
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    n = tests.where(valid).count()
    low = tests.where(valid & (F.col(p) <= q)).groupBy(F.col(p).alias("_p_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(low, "_p_value", "_n", "_b").withColumn("_r", F.col("_b") + F.col("_n"))
    cutoff = ranked.where(F.col("_p_value") <= F.col("_r") * q / max(n, 1)).agg(F.max("_p_value").alias("_cut"))
    return tests.join(F.broadcast(cutoff)).withColumn("significant", F.coalesce(valid & (F.col(p) <= F.col("_cut")), F.lit(False))).drop("_cut")


def residual_screen(residuals: DataFrame, q: float = 0.05) -> DataFrame:
    """z scores of residuals, their normal p, and false-discovery control. residuals: item_id, resid."""
    spread = F.broadcast(residuals.agg(F.avg("resid").alias("m"), F.stddev_pop("resid").alias("s")))
    z = residuals.join(spread).select("item_id", "resid", F.when(F.col("s") > 0, (F.col("resid") - F.col("m")) / F.col("s")).alias("z"))
    return benjamini_hochberg(z.withColumn("p", normal_two_sided_p(F.col("z"))), "p", q)


def extreme_items(residuals: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """The k hardest and k easiest items, overall or in each group. Ties go to the lower item_id.

    Overall, each task keeps its own k before they meet; by group, rows are ranked within groups cut into buckets first.
    """
    sides = []
    for side, order in (("hardest", F.desc("resid")), ("easiest", F.asc("resid"))):
        if group is None:
            top = residuals.orderBy(order, "item_id").limit(k)
            sides.append(top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "item_id"))).withColumn("side", F.lit(side)))
        else:
            bucket = F.pmod(F.xxhash64("item_id"), F.lit(64))
            pre = residuals.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(order, "item_id"))).where(F.col("_r") <= k).drop("_b", "_r")
            final = pre.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, "item_id"))).where(F.col("rank") <= k)
            sides.append(final.withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])
