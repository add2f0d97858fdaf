"""Item-response calibration: P(y = 1) = sigma(theta_model - b_item).

The data of a fit is one row per item with its answers packed in an array, so item-side sums never shuffle; only sums by
respondent move, one row each. The driver holds theta (a number per respondent) and, for the amortised fit, the network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.network import MLP, minimise_together
from plumbline.operators.responses import holdout_split, keep_covered, prune_saturated
from plumbline.operators.stats import running_total, spearman
from plumbline.plans.storage import Scratch

_STEP, _CAP, _FLOOR = 1.0, 8.0, 1e-6
#: Up to so many respondents the abilities' whole system is summed and solved.
_CURVED_MODELS = 2000
_NUMBERS_AT_ONCE = 4_000_000
_ITEMS_A_TASK = 5000


def _sigma(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def packed_items(cells: DataFrame, models: Sequence[str]) -> DataFrame:
    """item_id, answers: structs of the respondent's number in `models` and y, without missing ones."""
    panel = F.broadcast(cells.sparkSession.createDataFrame(list(enumerate(models)), "j int, model_id string"))
    known = cells.where(F.col("y").isNotNull()).join(panel, "model_id")
    return known.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("j", F.col("y").cast("double").alias("y")))).alias("answers"))


def _solved(j: np.ndarray, y: np.ndarray, item: np.ndarray, n: int, theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Difficulties of n items at given abilities, and the probability of each answer: Newton steps from 0, each at most 1,
    the result within +-8."""
    b, ability = np.zeros(n), theta[j]
    p = 1 / (1 + np.exp(b[item] - ability))
    for _ in range(steps):
        g, h = np.bincount(item, y - p, n), np.bincount(item, p * (1 - p), n)
        b = np.clip(b - np.clip(g / np.maximum(h, _FLOOR), -_STEP, _STEP), -_CAP, _CAP)
        p = 1 / (1 + np.exp(b[item] - ability))
    return b, p


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Respondent, outcome and item of each answer of a batch."""
    j, y = batch.column("j"), batch.column("y")
    item = np.repeat(np.arange(batch.num_rows), np.diff(j.offsets.to_numpy()))
    return j.flatten().to_numpy(), y.flatten().to_numpy(), item


def _ability_sums(batches: Iterator[pa.RecordBatch], theta: np.ndarray, steps: int, curved: bool) -> Iterator[pa.RecordBatch]:
    """Slopes of the profile likelihood in the abilities (at -1 - j) over a task's items, whose difficulties are solved on the way, and its
    curvature: all products of respondents j and k (at j * models + k), or only the part without items' answers to them (`curved` false)."""
    models = len(theta)
    g, h = np.zeros(models), np.zeros((models, models) if curved else models)
    for batch in batches:
        j, y, item = _unpacked(batch)
        _, p = _solved(j, y, item, batch.num_rows, theta, steps)
        v = p * (1 - p)
        g += np.bincount(j, y - p, models)
        if not curved:
            h += np.bincount(j, v, models)
            continue
        h[np.arange(models), np.arange(models)] += np.bincount(j, v, models)
        # an item's difficulty moves along with the abilities: its row of curvatures is eliminated
        total = np.bincount(item, v, batch.num_rows)
        share = v / np.sqrt(np.maximum(total, _FLOOR))[item]
        step = max(1, _NUMBERS_AT_ONCE // models)
        ends = np.searchsorted(item, np.arange(0, batch.num_rows + step, step))
        for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            rows = np.zeros((min(step, batch.num_rows - k * step), models))
            rows[item[lo:hi] - k * step, j[lo:hi]] = share[lo:hi]
            h -= rows.T @ rows
    at = np.concatenate([-1 - np.arange(models), np.arange(h.size) * (1 if curved else models + 1)])
    value = np.concatenate([g, h.ravel()])
    some = np.flatnonzero(value)
    for lo in range(0, len(some), 100_000):
        own = some[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(value[own])], ["at", "value"])


def _difficulties(batches: Iterator[pa.RecordBatch], theta: np.ndarray, steps: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        j, y, item = _unpacked(batch)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(_solved(j, y, item, batch.num_rows, theta, steps)[0])], ["item_id", "b"])


def _ability_step(found: pa.Table, models: int, curved: bool) -> np.ndarray:
    """The Newton step of the abilities, of mean 0: the likelihood is the same if all move together, so that direction is left out."""
    at, value = found.column("at").to_numpy(), found.column("value").to_numpy()
    g = np.zeros(models)
    g[-1 - at[at < 0]] = value[at < 0]
    h = np.zeros(models * models if curved else models)
    h[at[at >= 0] // (1 if curved else models + 1)] = value[at >= 0]
    if not curved:
        return g / np.maximum(h, _FLOOR)
    h = h.reshape(models, models)
    scale = max(np.trace(h) / models, _FLOOR)
    # respondents that no item ties to the others have a flat direction of their own, where the least step is taken
    return np.linalg.pinv(h + scale / models, rcond=1e-10, hermitian=True) @ (g - g.mean())


def fit_rasch(cells: DataFrame, max_iter: int = 25, tol: float = 1e-8, anchor: str = "theta", inner: int = 12) -> tuple[DataFrame, DataFrame]:
    """Joint maximum likelihood of abilities and difficulties: item_fit (item_id, b) and model_fit (model_id, theta).

    The system of a Newton step is an arrowhead: an item's difficulty is tied to abilities only. So each task solves and eliminates its items,
    and one system of respondents by respondents is left for the driver. It converges quadratically, in some six rounds; a step is at most 1.
    With more than 2,000 respondents, only the system's diagonal is used, and rounds are more.
    `theta` anchors the mean ability at 0, moving the difficulties along, which keeps the likelihood; `both` centres the
    difficulties by themselves, too. Saturated items have no finite optimum (prune them first); they stop at +-8.
    """
    if anchor not in ("theta", "both"):
        raise ValueError(anchor)
    spark = cells.sparkSession
    models = [r[0] for r in cells.where("y IS NOT NULL").select("model_id").distinct().orderBy("model_id").collect()]
    scratch = Scratch(spark, "rasch")
    packed = packed_items(cells, models).select("item_id", F.col("answers.j").alias("j"), F.col("answers.y").alias("y"))
    items = scratch.table(packed, "items")
    theta, curved = np.zeros(len(models)), len(models) <= _CURVED_MODELS
    for _ in range((max_iter if curved else 20 * max_iter) if models else 0):
        parts = items.select("j", "y").mapInArrow(partial(_ability_sums, theta=theta, steps=inner, curved=curved), "at long, value double")
        step = _ability_step(parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow(), len(models), curved)
        step = np.clip(step, -_STEP, _STEP)
        theta = theta + step
        theta -= theta.mean()
        if np.abs(step).max() < tol:
            break
    solved = items.mapInArrow(partial(_difficulties, theta=theta, steps=inner), f"item_id {dict(items.dtypes)['item_id']}, b double")
    item_fit = scratch.table(solved, "item-fit")
    scratch.drop("items")
    if anchor == "both":
        mean = item_fit.agg(F.avg("b")).first()[0] or 0.0
        item_fit = item_fit.withColumn("b", F.col("b") - mean)
    return item_fit, spark.createDataFrame([(m, float(t)) for m, t in zip(models, theta, strict=True)], "model_id string, theta double")


def predict_prob(model_fit: DataFrame, item_fit: DataFrame) -> DataFrame:
    """The probability of a right answer for every pair; the respondents, a settings list, are broadcast."""
    return item_fit.select("item_id", "b").crossJoin(F.broadcast(model_fit.select("model_id", "theta"))).select("model_id", "item_id", _sigma(F.col("theta") - F.col("b")).alias("p"))


def cell_probabilities(cells: DataFrame, model_fit: DataFrame, item_fit: DataFrame) -> DataFrame:
    """Answered cells with their predicted probability."""
    joined = cells.where("y IS NOT NULL").join(F.broadcast(model_fit.select("model_id", "theta")), "model_id").join(item_fit.select("item_id", "b"), "item_id")
    return joined.withColumn("p", _sigma(F.col("theta") - F.col("b")))


def heldout_auc(scored: DataFrame, digits: int = 12) -> DataFrame:
    """AUC over all answered pairs pooled; NULL with one class. Pairs are counted by score, and the counts are summed in order."""
    counts = scored.where("y IS NOT NULL").groupBy(F.round("p", digits).alias("score")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = running_total(counts, "score", "neg", "below")
    total = ranked.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"))
    return total.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).alias("auc"), F.coalesce(F.col("P") + F.col("N"), F.lit(0)).alias("n"))


def infit_outfit(cells: DataFrame, model_fit: DataFrame, item_fit: DataFrame) -> DataFrame:
    """Per item of the fit: variance-weighted and plain mean squares of residuals; NULL without answers."""
    scored = cell_probabilities(cells, model_fit, item_fit).withColumn("v", F.col("p") * (1 - F.col("p"))).withColumn("r2", F.pow(F.col("y") - F.col("p"), 2))
    sums = scored.groupBy("item_id").agg(
        F.avg(F.col("r2") / F.greatest("v", F.lit(1e-6))).alias("outfit"), F.when(F.sum("v") > 0, F.sum("r2") / F.sum("v")).alias("infit")
    )
    return item_fit.join(sums, "item_id", "left")


def misfit_flags(item_fit: DataFrame, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """Adds misfit: whether infit or outfit lies outside the bounds; NULL where both are unknown."""
    out = lambda c: ~F.col(c).between(low, high)
    return item_fit.withColumn("misfit", F.when(F.col("infit").isNull() & F.col("outfit").isNull(), None).otherwise(F.coalesce(out("infit"), F.lit(False)) | F.coalesce(out("outfit"), F.lit(False))))


def compare_fits(item_a: DataFrame, model_a: DataFrame, item_b: DataFrame, model_b: DataFrame) -> DataFrame:
    """Spearman of two calibrations, over items and over respondents."""
    items = item_a.select("item_id", F.col("b").alias("x")).join(item_b.select("item_id", F.col("b").alias("y")).hint("merge"), "item_id")
    models = model_a.select("model_id", F.col("theta").alias("x")).join(model_b.select("model_id", F.col("theta").alias("y")), "model_id")
    return spearman(items, "x", "y").select(F.lit("items").alias("over"), "n", "rho").union(spearman(models, "x", "y").select(F.lit("respondents"), "n", "rho"))


def configural_invariance(
    cells: DataFrame, items: DataFrame, group_a: str = "I-II", group_b: str = "V-VI", fit: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = fit_rasch, cutoff: float = 0.9
) -> DataFrame:
    """Refits on the items of two groups; Spearman of the abilities, and whether it is above the cutoff (NULL if undefined)."""
    fits = [fit(cells.join(items.where(F.col("grp") == g).select("item_id"), "item_id", "left_semi"))[1] for g in (group_a, group_b)]
    joined = fits[0].select("model_id", F.col("theta").alias("x")).join(fits[1].select("model_id", F.col("theta").alias("y")), "model_id")
    return spearman(joined, "x", "y").select("n", "rho").withColumn("invariant", F.col("rho") > cutoff)


def validation_gate(auc: DataFrame, rho: DataFrame, min_auc: float = 0.65, min_rho: float = 0.7) -> DataFrame:
    """Whether the amortised fit is accepted, or the plain one is to be used instead."""
    both = auc.select("auc").crossJoin(rho.select("rho"))  # one row by one row
    ok = F.coalesce((F.col("auc") >= min_auc) & (F.col("rho") >= min_rho), F.lit(False))
    return both.withColumn("accepted", ok).withColumn("use", F.when(ok, "amortized").otherwise("rasch"))


def ability_leaderboard(model_fit: DataFrame, answers: DataFrame) -> DataFrame:
    """Respondents by ability, beside their share of positive answers. Their number is that of a settings list."""
    from pyspark.sql import Window

    share = answers.where("y IS NOT NULL").groupBy("model_id").agg(F.avg((F.col("label") == "malignant").cast("int")).alias("positive_share"))
    ranked = model_fit.withColumn("rank", F.rank().over(Window.orderBy(F.desc("theta"))))
    return ranked.join(share, "model_id", "left")


# -- amortised difficulty ------------------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _gradients(frames: Iterator[pd.DataFrame], shared, dims: int, hidden: int) -> Iterator[pd.DataFrame]:
    """One vector per partition: for each lane, the sum of its items' losses and gradients (theta, then the network's weights)."""
    lanes = shared.value
    totals = [np.zeros(len(vector) + 1) for _, vector, _, _ in lanes]
    for frame in frames:
        if not len(frame):
            continue
        e, bits, sizes = _matrix(frame["embedding"]), frame["lanes"].to_numpy(np.int64), np.array([len(x) for x in frame["j"]])
        j, y = np.concatenate(frame["j"].tolist()).astype(np.int64), np.concatenate(frame["y"].tolist())
        row = np.repeat(np.arange(len(frame)), sizes)
        for total, (lane, vector, seat, difficulty_l2) in zip(totals, lanes, strict=True):
            n_models = int(seat.max(initial=-1)) + 1
            theta, net = vector[:n_models], MLP(dims, hidden, vector[n_models:])
            own = (bits >> lane) & 1 == 1
            if not own.any():
                continue
            place = np.cumsum(own) - 1
            here = own[row]
            jj, yy, rr = seat[j[here]], y[here], place[row[here]]
            b, tape = net.forward(e[own])
            logit = theta[jj] - b[rr]
            total[0] += np.logaddexp(0, logit).sum() - (yy * logit).sum() + difficulty_l2 * (b * b).sum()
            error = 1 / (1 + np.exp(-logit)) - yy
            total[1 : n_models + 1] += np.bincount(jj, error, n_models)
            total[n_models + 1 :] += net.backward(tape, -np.bincount(rr, error, len(b)) + 2 * difficulty_l2 * b)
    whole = np.concatenate(totals)
    yield pd.DataFrame({"at": np.arange(len(whole)), "value": whole})


class AmortizedFit:
    """Abilities by respondent, the difficulty network, and the objective's history."""

    def __init__(self, models: list[str], theta: np.ndarray, network: MLP, history: list[float]):
        self.models, self.theta, self.network, self.history = models, theta, network, history

    def model_fit(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m, float(t)) for m, t in zip(self.models, self.theta, strict=True)], "model_id string, theta double")


class AmortizedJob:
    """Fits on the same packed items, evaluated together: each evaluation is one scan, in which a task sums the gradients of all lanes.

    A lane is a fit: its penalties, its seed, and the items whose bit it has in `lanes` (item_id, lanes; all items without it). A lane's
    respondents are those who answered one of its items. The driver gets one vector per lane, however many tasks there are.
    """

    def __init__(self, cells: DataFrame, embeddings: DataFrame, points: Sequence[Mapping], hidden: int = 128, lanes: DataFrame | None = None):
        self.spark, self.hidden = cells.sparkSession, hidden
        self.points = [{"seed": 0xDD1F, "ability_l2": 1e-2, "difficulty_l2": 1e-2, "weight_decay": 1e-4} | dict(p) for p in points]
        if len(self.points) > 62:
            raise ValueError("at most 62 fits at once")
        known = cells.where("y IS NOT NULL")
        known = known.withColumn("lanes", F.lit((1 << len(self.points)) - 1)) if lanes is None else known.join(lanes.select("item_id", F.col("lanes").cast("long").alias("lanes")), "item_id")
        known = Scratch(self.spark, "amortized").table(known.select("model_id", "item_id", "y", "lanes"), "cells")
        asked = {r.model_id: r.lanes for r in known.groupBy("model_id").agg(F.bit_or("lanes").alias("lanes")).collect()}
        every = sorted(asked)
        self.models = [[m for m in every if asked[m] >> k & 1] for k in range(len(self.points))]
        self.seats = [np.cumsum([asked[m] >> k & 1 for m in every]) - 1 if every else np.zeros(0, np.int64) for k in range(len(self.points))]
        joined = packed_items(known, every).join(known.groupBy("item_id").agg(F.max("lanes").alias("lanes")), "item_id").join(embeddings.select("item_id", "embedding"), "item_id")
        rows = Scratch(self.spark, "amortized").table(joined.select("embedding", "lanes", F.col("answers.j").alias("j"), F.col("answers.y").alias("y")), "rows")
        # a task costs more than the gradients of some thousand items
        self.parts = max(1, -(-rows.count() // _ITEMS_A_TASK))
        self.rows = (rows.coalesce(1) if self.parts == 1 else rows.repartition(self.parts)).persist()
        self.dims = (self.rows.select(F.size("embedding")).first() or [0])[0]

    def start(self, lane: int) -> np.ndarray:
        return np.concatenate([np.zeros(len(self.models[lane])), MLP.initial(self.dims, self.hidden, self.points[lane]["seed"])])

    def evaluate(self, vectors: Mapping[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        """The objective and its gradient of some lanes at some vectors: masked likelihood, L2 on theta, b and weights, mean theta held at 0."""
        shared = self.spark.sparkContext.broadcast([(k, v, self.seats[k], self.points[k]["difficulty_l2"]) for k, v in vectors.items()])
        found = self.rows.mapInPandas(partial(_gradients, shared=shared, dims=self.dims, hidden=self.hidden), "at int, value double")
        found = (found if self.parts == 1 else found.groupBy("at").agg(F.sum("value").alias("value"))).toPandas()
        shared.destroy()
        total = np.zeros(sum(len(v) + 1 for v in vectors.values()))
        total[found["at"]] = found["value"]
        out, at = {}, 0
        for k, vector in vectors.items():
            n, point = len(self.models[k]), self.points[k]
            loss, gradient = total[at], total[at + 1 : at + 1 + len(vector)].copy()
            at += len(vector) + 1
            theta, weights = vector[:n], vector[n:]
            mean = theta.mean() if n else 0.0
            loss += point["ability_l2"] * (theta @ theta) + 1e3 * mean**2 + 0.5 * point["weight_decay"] * (weights @ weights)
            gradient[:n] += 2 * point["ability_l2"] * theta + (2e3 * mean / n if n else 0)
            gradient[n:] += point["weight_decay"] * weights
            out[k] = float(loss), gradient
        return out

    def close(self) -> None:
        self.rows.unpersist()


def fit_amortized_together(
    cells: DataFrame, embeddings: DataFrame, points: Sequence[Mapping], hidden: int = 128, max_iter: int = 60, lanes: DataFrame | None = None
) -> list[AmortizedFit]:
    """The fits of several settings (seed, ability_l2, difficulty_l2, weight_decay) or item subsets, in the scans of one.

    `lanes` (item_id, lanes) has bit k set where the item belongs to the fit of points[k]. Each is what `fit_amortized` gives alone.
    """
    job = AmortizedJob(cells, embeddings, points, hidden, lanes)
    try:
        found = minimise_together(job.evaluate, [job.start(k) for k in range(len(points))], max_iter)
    finally:
        job.close()
    return [AmortizedFit(m, best[: len(m)], MLP(job.dims, hidden, best[len(m) :]), history) for m, (best, history) in zip(job.models, found, strict=True)]


def fit_amortized(
    cells: DataFrame,
    embeddings: DataFrame,
    hidden: int = 128,
    ability_l2: float = 1e-2,
    difficulty_l2: float = 1e-2,
    weight_decay: float = 1e-4,
    seed: int = 0xDD1F,
    max_iter: int = 60,
) -> AmortizedFit:
    """Rasch abilities with difficulty b = MLP(embedding). The optimiser is L-BFGS; it needs tens of evaluations, each one job."""
    point = {"seed": seed, "ability_l2": ability_l2, "difficulty_l2": difficulty_l2, "weight_decay": weight_decay}
    return fit_amortized_together(cells, embeddings, [point], hidden, max_iter)[0]


def score_difficulty(fit: AmortizedFit, embeddings: DataFrame) -> DataFrame:
    """Difficulty of any item with an embedding: held out, pruned or new. The network goes to the tasks once."""
    shared = embeddings.sparkSession.sparkContext.broadcast(fit.network)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"item_id": frame["item_id"], "b": shared.value.forward(_matrix(frame["embedding"]))[0] if len(frame) else []})

    return embeddings.select("item_id", "embedding").mapInPandas(scored, f"item_id {dict(embeddings.dtypes)['item_id']}, b double")


def calibrate(
    cells: DataFrame, items: DataFrame, embeddings: DataFrame, min_n: int = 600, prune: bool = True, holdout: float = 0.2, seed: int = 0xDD1F, **options
) -> dict[str, DataFrame]:
    """Coverage, pruning, a held-out AUC, the full fit, scores of all items and their fit statistics.

    Returns item_fit (item_id, b, infit, outfit, in_fit), model_fit and fit_meta (holdout_auc, n_answers, n_pruned).
    """
    spark = cells.sparkSession
    scratch = Scratch(spark, "calibrate")
    covered = scratch.table(keep_covered(cells, min_n), "cells")
    used = prune_saturated(covered) if prune else covered
    fit_items = scratch.table(used.select("item_id").distinct().join(embeddings.select("item_id"), "item_id", "left_semi"), "fit-items")
    split = scratch.table(holdout_split(fit_items, holdout, seed), "split")
    shared = {k: options.pop(k) for k in ("hidden", "max_iter") if k in options}
    both = split.select("item_id", F.when(F.col("holdout"), 2).otherwise(3).alias("lanes"))
    train, full = fit_amortized_together(used, embeddings, [{"seed": seed, **options}] * 2, lanes=both, **shared)
    held = used.join(split.where("holdout").select("item_id"), "item_id", "left_semi")
    auc = heldout_auc(cell_probabilities(held, train.model_fit(spark), score_difficulty(train, embeddings)))
    model_fit = full.model_fit(spark)
    wanted = embeddings.join(items.select("item_id"), "item_id", "left_semi")
    fitted = infit_outfit(covered, model_fit, score_difficulty(full, wanted)).join(fit_items.withColumn("in_fit", F.lit(True)), "item_id", "left")
    n_pruned = covered.select("item_id").distinct().count() - used.select("item_id").distinct().count()
    meta = auc.select(F.col("auc").alias("holdout_auc"), F.col("n").alias("n_answers"), F.lit(n_pruned).alias("n_pruned"))
    return {"item_fit": fitted.withColumn("in_fit", F.coalesce("in_fit", F.lit(False))), "model_fit": model_fit, "fit_meta": meta}


def sweep(cells: DataFrame, embeddings: DataFrame, points: Sequence[Mapping], run: Callable[[AmortizedFit], DataFrame], **options) -> DataFrame:
    """One row of results per grid point (seeds, penalties), all fitted in the same scans; `run` makes a fit's row."""
    if not points:
        raise ValueError("no grid points")
    out = None
    for point, fit in zip(points, fit_amortized_together(cells, embeddings, points, **options), strict=True):
        row = run(fit).withColumns({k: F.lit(v) for k, v in point.items()})
        out = row if out is None else out.unionByName(row)
    return out


def configural_invariance_amortized(cells: DataFrame, items: DataFrame, embeddings: DataFrame, group_a: str = "I-II", group_b: str = "V-VI", cutoff: float = 0.9, **options) -> DataFrame:
    """Like `configural_invariance`, by the amortised model: both groups' fits in the same scans."""
    lanes = items.where(F.col("grp").isin(group_a, group_b)).select("item_id", F.when(F.col("grp") == group_a, 1).otherwise(2).alias("lanes"))
    fits = [f.model_fit(cells.sparkSession) for f in fit_amortized_together(cells, embeddings, [{}, {}], lanes=lanes, **options)]
    joined = fits[0].select("model_id", F.col("theta").alias("x")).join(fits[1].select("model_id", F.col("theta").alias("y")), "model_id")
    return spearman(joined, "x", "y").select("n", "rho").withColumn("invariant", F.col("rho") > cutoff)
