"""Regressions of difficulty and correctness, bootstrap intervals, and the decision on group invariance.

Items enter only through cells (the combinations of the factors' levels) and moments of numeric features in them. Cells and levels stay in
Spark at any number; the driver holds coefficients, and the normal equations while they are small. Beyond, conjugate gradients
sum what each task's cells contribute. Bootstrap weights are Poisson(1) hash draws of (seed, replicate, item) instead of exactly n draws:
independent of partitioning. Item identifiers may be numbers or texts, whose hashes are drawn. A replicate's cells are one task's at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.kernels import hash_draw, hash_draws, poisson_weights
from plumbline.functions.lanes import Lanes, conjugate_gradients, least_solution
from plumbline.functions.network import minimise_together
from plumbline.plans.lookup import join_facts
from plumbline.plans.ranks import gapless_rank
from plumbline.plans.storage import Scratch

#: Up to so many terms the normal equations go to the driver; beyond, they are solved without being formed.
_GRAM_TERMS = 1500
_LEVELS_AT_HAND = 100_000
#: Cells that one task fits alone, cells times replicates that it holds, and numbers of other terms that it has for its levels.
_CELLS_A_TASK = 200_000
_LANE_CELLS = 1_000_000
_LEVEL_NUMBERS = 1_000_000
#: Numbers that a bootstrap's task sums at a time, and items that it weighs at a time.
_SUMS_AT_ONCE = 2_000_000
_ITEMS_AT_ONCE = 200_000
_REPLICATES_AT_ONCE = 100


def design(items: DataFrame, features: Sequence[str]) -> DataFrame:
    """The design in long form: item_id, term, value. String and boolean features become dummies without the alphabetically
    first level (absent terms are 0), numbers become z scores by the population spread, floored at 1e-8."""
    kinds = dict(items.dtypes)
    out = items.select("item_id", F.lit("(intercept)").alias("term"), F.lit(1.0).alias("value"))
    for f in features:
        if kinds[f] in ("string", "boolean"):
            level = F.initcap(F.col(f).cast("string")) if kinds[f] == "boolean" else F.col(f)
            first = F.broadcast(items.agg(F.min(level).alias("_first")))
            part = items.join(first).where(level != F.col("_first")).select("item_id", F.concat(F.lit(f + "_"), level).alias("term"), F.lit(1.0).alias("value"))
        else:
            spread = F.broadcast(items.agg(F.avg(f).alias("_m"), F.greatest(F.stddev_pop(f), F.lit(1e-8)).alias("_s")))
            part = items.join(spread).select("item_id", F.lit(f).alias("term"), ((F.col(f) - F.col("_m")) / F.col("_s")).alias("value"))
        out = out.unionByName(part)
    return out


def split_features(frame: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Factors (strings and booleans) and numeric features."""
    kinds = dict(frame.dtypes)
    factors = [f for f in features if kinds[f] in ("string", "boolean")]
    return factors, [f for f in features if f not in factors]


def with_moments(frame: DataFrame, numeric: Sequence[str], value: str) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with numeric features as z scores (population spread, floored at 1e-8), `_z0`, `_z1`, ..., and the terms whose
    sums a design needs: n, s and those of the features."""
    if numeric:
        spread = F.broadcast(frame.agg(*[c for i, f in enumerate(numeric) for c in (F.avg(f).alias(f"_m{i}"), F.greatest(F.stddev_pop(f), F.lit(1e-8)).alias(f"_s{i}"))]))
        frame = frame.join(spread)  # one row
        frame = frame.withColumns({f"_z{i}": (F.col(f) - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, f in enumerate(numeric)})
        frame = frame.drop(*[f"_{c}{i}" for i in range(len(numeric)) for c in "ms"])
    y = F.col(value).cast("double")
    terms = {"n": F.lit(1.0), "s": y}
    for i in range(len(numeric)):
        terms[f"z{i}"], terms[f"z{i}s"] = F.col(f"_z{i}"), F.col(f"_z{i}") * y
        terms |= {f"z{i}z{k}": F.col(f"_z{i}") * F.col(f"_z{k}") for k in range(i, len(numeric))}
    return frame, terms


class Coded:
    """A frame with a column of term numbers `_f{i}` for each factor, -1 for the reference level; numeric terms come last.

    The reference is the first level by name, or the one given in `first`. Nulls are the level `None`.
    """

    def __init__(self, frame: DataFrame, factors: Sequence[str], numeric: Sequence[str] = (), first: dict[str, str] | None = None):
        spark, kinds = frame.sparkSession, dict(frame.dtypes)
        name = lambda f: F.coalesce(F.initcap(F.col(f).cast("string")) if kinds[f] == "boolean" else F.col(f).cast("string"), F.lit("None"))
        self.factors, self.numeric = list(factors), list(numeric)
        self.columns = [f"_f{i}" for i in range(len(factors))]
        self.spans, self.terms, self.references = [], 1, []
        self.names = spark.createDataFrame([(0, "(intercept)")], "term_no long, term string")
        for i, f in enumerate(factors):
            levels = Scratch(spark, "levels").table(frame.groupBy(name(f).alias("_level")).agg(F.count(F.lit(1)).alias("_n")), "levels")
            size, least, total = levels.agg(F.count(F.lit(1)), F.min("_level"), F.sum("_n")).first()
            reference = first[f] if first and f in first else least
            others = levels.where(F.col("_level") != F.lit(reference))
            if size <= _LEVELS_AT_HAND:
                known = sorted(r[0] for r in others.select("_level").collect())
                table = spark.createDataFrame([(level, self.terms + k) for k, level in enumerate(known)], "_level string, _term int")
                n_terms = len(known)
                coded = frame.withColumn("_level", name(f)).join(F.broadcast(table), "_level", "left").withColumn(self.columns[i], F.coalesce("_term", F.lit(-1)))
            else:
                bucket = F.pmod(F.xxhash64("_level"), F.lit(max(1, size // 1000)))
                ranked = gapless_rank(others, [], bucket, [F.col("_level")], "_rank").select("_level", (F.col("_rank") + self.terms).cast("int").alias("_term"), "_n")
                n_terms = others.count()
                table = Scratch(spark, "levels").table(ranked.union(levels.where(F.col("_level") == F.lit(reference)).select("_level", F.lit(-1), "_n")), "terms")
                coded = join_facts(frame.withColumn("_level", name(f)), table, ["_level"], "_n", total).drop("_n").withColumnRenamed("_term", self.columns[i])
                table = table.where("_term > 0")
            frame = coded.drop("_level", "_term")
            self.names = self.names.union(table.select(F.col("_term").cast("long"), F.concat(F.lit(f + "_"), "_level")))
            self.spans.append((self.terms, self.terms + n_terms))
            self.references.append(reference)
            self.terms += n_terms
        self.first_numeric = self.terms
        self.terms += len(numeric)
        if numeric:
            self.names = self.names.union(spark.createDataFrame([(self.first_numeric + k, f) for k, f in enumerate(numeric)], "term_no long, term string"))
        self.frame = frame

    def lanes(self, codes: Sequence[np.ndarray]) -> Lanes:
        return Lanes(codes, self.spans, self.terms, len(self.numeric))

    def named(self, beta: np.ndarray) -> DataFrame:
        """term, beta."""
        rows = pa.table({"term_no": np.arange(len(beta)), "beta": np.asarray(beta, float)})
        return self.frame.sparkSession.createDataFrame(rows).join(self.names, "term_no").select("term", "beta")


def cells_of(coded: Coded, terms: dict[str, Column], value: str, name: str) -> DataFrame:
    """A row for each combination of levels, with the terms' sums and q (of the outcome's square). Rows without an outcome don't count."""
    sums = [F.sum(c).alias(k) for k, c in (terms | {"q": F.pow(F.col(value).cast("double"), 2)}).items()]
    rows = coded.frame.where(F.col(value).isNotNull()).groupBy(*coded.columns).agg(*sums)
    return Scratch(coded.frame.sparkSession, name).table(rows.where("n > 0"), "cells")


def _arrays(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of all batches of a task."""
    held = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return {n: np.concatenate([h[i] for h in held]) if held else np.zeros(0) for i, n in enumerate(names)}


def _sparse(position: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the values by position, as rows."""
    own, at = np.unique(position, return_inverse=True)
    sums = np.bincount(at, value, len(own)) if len(own) else np.zeros(0)
    for lo in range(0, len(own), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 100_000].astype(np.int64)), pa.array(sums[lo : lo + 100_000])], ["at", "value"])


def _collected(parts: DataFrame, size: int) -> np.ndarray:
    """A vector from the tasks' parts of it."""
    found = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


def _products(batches: Iterator[pa.RecordBatch], columns: Sequence[str], terms: int, numeric: int) -> Iterator[pa.RecordBatch]:
    """A task's part of the upper triangle of X'WX, with X'Wy as column `terms` and the outcome's square behind it."""
    names = ["n", "s", "q", *(n for k in range(numeric) for n in (f"z{k}", f"z{k}s", *(f"z{k}z{m}" for m in range(k, numeric))))]
    for batch in batches:
        data = _arrays(iter([batch]), [*columns, *names])
        width, first = terms + 1, terms - numeric
        codes = [np.zeros(batch.num_rows, np.int64), *(data[c].astype(np.int64) for c in columns)]
        at, value = [np.full(batch.num_rows, terms * width + terms)], [data["q"]]
        for i, a in enumerate(codes):
            for b in codes[: i + 1]:
                both = (a >= 0) & (b >= 0)
                at.append((np.minimum(a, b) * width + np.maximum(a, b))[both])
                value.append(data["n"][both])
            for column, name in [(terms, "s"), *((first + k, f"z{k}") for k in range(numeric))]:
                at.append((a * width + column)[a >= 0])
                value.append(data[name][a >= 0])
        for k in range(numeric):
            for column, name in [(terms, f"z{k}s"), *((first + m, f"z{k}z{m}") for m in range(k, numeric))]:
                at.append(np.full(batch.num_rows, (first + k) * width + column))
                value.append(data[name])
        yield from _sparse(np.concatenate(at), np.concatenate(value))


def _vectors(batches: Iterator[pa.RecordBatch], columns: Sequence[str], coded_spans, terms: int, numeric: int, shared) -> Iterator[pa.RecordBatch]:
    """A task's part of X'WX beta; without beta, of the diagonal, X'Wy (`terms` behind it) and the outcome's square."""
    names = ["n", "s", "q", *(n for k in range(numeric) for n in (f"z{k}", f"z{k}s", *(f"z{k}z{m}" for m in range(k, numeric))))]
    total = np.zeros(terms if shared is not None else 2 * terms + 1)
    for batch in batches:
        data = _arrays(iter([batch]), [*columns, *names])
        lanes = Lanes([data[c] for c in columns], coded_spans, terms, numeric)
        sums = {n: data[n][None] for n in names}
        if shared is not None:
            total += lanes.apply(sums, shared.value[None])[0]
        else:
            total[:terms] += lanes.own_squares(sums)[0]
            total[terms:-1] += lanes._moment(sums["s"], [sums[f"z{k}s"] for k in range(numeric)])[0]
            total[-1] += data["q"].sum()
    some = np.flatnonzero(total)
    yield from _sparse(some, total[some])


class Equations:
    """The normal equations of a cell table, formed only while they are small."""

    def __init__(self, coded: Coded, cells: DataFrame):
        self.coded, self.cells = coded, cells
        k, p = len(coded.numeric), coded.terms
        self.gram = None
        if p <= _GRAM_TERMS:
            run = partial(_products, columns=coded.columns, terms=p, numeric=k)
            found = _collected(cells.mapInArrow(run, "at long, value double"), (p + 1) ** 2).reshape(p + 1, p + 1)
            upper = np.triu(found[:p, :p])
            self.gram, self.moment, self.squares = upper + np.triu(upper, 1).T, found[:p, p], float(found[p, p])
            self.own = np.diagonal(self.gram)
        else:
            found = self._job(None, 2 * p + 1)
            self.own, self.moment, self.squares = found[:p], found[p:-1], float(found[-1])

    def _job(self, beta: np.ndarray | None, size: int) -> np.ndarray:
        coded = self.coded
        shared = None if beta is None else self.cells.sparkSession.sparkContext.broadcast(beta)
        run = partial(_vectors, columns=coded.columns, coded_spans=coded.spans, terms=coded.terms, numeric=len(coded.numeric), shared=shared)
        out = _collected(self.cells.mapInArrow(run, "at long, value double"), size)
        if shared is not None:
            shared.destroy()
        return out

    def solve(self, features: Sequence[str] | None = None) -> tuple[np.ndarray, np.ndarray, float | None]:
        """Coefficients (0 for terms of other features), which terms are used, and the share of variance explained (None if there is none)."""
        coded, used = self.coded, np.zeros(self.coded.terms, bool)
        used[0] = True
        for f, (a, z) in zip(coded.factors, coded.spans, strict=True):
            used[a:z] = features is None or f in features
        for k, f in enumerate(coded.numeric):
            used[coded.first_numeric + k] = features is None or f in features
        beta = np.zeros(coded.terms)
        if self.gram is not None:
            at = np.flatnonzero(used)
            beta[at] = least_solution(self.gram[np.ix_(at, at)], self.moment[at])
        else:
            beta = conjugate_gradients(lambda x: np.where(used, self._job(x[0], coded.terms), 0)[None], np.where(used, self.moment, 0)[None], np.where(used, self.own, 0)[None])[0]
        n = self.own[0]
        total = self.squares - self.moment[0] ** 2 / n if n > 0 else 0.0
        return beta, used, float(1 - (self.squares - beta @ self.moment) / total) if total > 0 else None


def residualize(item_fit: DataFrame, items: DataFrame, controls: Sequence[str] = ("category", "truth")) -> DataFrame:
    """The items' columns with b and resid: difficulty less its least-squares fit on the controls, factors or numeric.

    Controls may determine each other: the fit is the same for all solutions.
    """
    frame = item_fit.select("item_id", "b").join(items, "item_id")
    if not controls:
        mean = F.broadcast(frame.agg(F.avg("b").alias("_m")))
        return frame.join(mean).withColumn("resid", F.col("b") - F.col("_m")).drop("_m")
    factors, numeric = split_features(frame, controls)
    scaled, terms = with_moments(Scratch(frame.sparkSession, "residuals").table(frame, "frame"), numeric, "b")
    coded = Coded(scaled, factors, numeric)
    beta, _, _ = Equations(coded, cells_of(coded, terms, "b", "residuals")).solve()
    fit = F.lit(float(beta[0]))
    if factors:
        shared = frame.sparkSession.sparkContext.broadcast(np.append(beta, 0.0))

        @F.pandas_udf("double")
        def effects(*codes: pd.Series) -> pd.Series:
            return sum((pd.Series(shared.value[c.to_numpy()]) for c in codes), pd.Series(np.zeros(len(codes[0]))))

        fit = fit + effects(*coded.columns)
    for i in range(len(numeric)):
        fit = fit + F.col(f"_z{i}") * float(beta[coded.first_numeric + i])
    return coded.frame.withColumn("resid", F.col("b") - fit).drop(*coded.columns, *[f"_z{i}" for i in range(len(numeric))])


def group_shift(resid: DataFrame, focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    """Mean residual of the focal less that of the reference group, and their numbers of items."""
    at = lambda g: F.when(F.col("grp") == g, F.col("resid"))
    return resid.agg((F.avg(at(focal)) - F.avg(at(reference))).alias("delta"), F.count(at(focal)).alias("n_focal"), F.count(at(reference)).alias("n_reference"))


def item_key(frame: DataFrame) -> Column:
    """A whole number for an item: the identifier itself, or the hash of one that is no whole number."""
    whole = dict(frame.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    return F.col("item_id").cast("long") if whole else F.pmod(F.xxhash64("item_id"), F.lit((1 << 31) - 1))


def _joint(codes: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each row's combination of codes, and the codes of each number."""
    key = np.zeros(len(codes[0]), np.int64)
    for c in codes:
        _, own = np.unique(c, return_inverse=True)
        _, key = np.unique(key * (own.max(initial=0) + 1) + own, return_inverse=True)
    _, one = np.unique(key, return_index=True)
    return key, [c[one] for c in codes]


def _weighted(frames: Iterator[pd.DataFrame], replicates: int, seed: int, columns: Sequence[str], included: float | None) -> Iterator[pd.DataFrame]:
    """Sums over items of weight and weight times each value, by replicate and cell, for one stretch of items and replicates at a time."""
    held: list[pd.DataFrame] = []

    def summed() -> Iterator[pd.DataFrame]:
        part = pd.concat(held)
        names = [c for c in part.columns if c != "_item" and c not in columns]
        ids = part["_item"].to_numpy(np.int64)
        cell, codes = _joint([part[c].to_numpy(np.int64) for c in columns]) if columns else (np.zeros(len(part), np.int64), [])
        order = np.argsort(cell, kind="stable")
        own, starts = np.unique(cell[order], return_index=True)
        values = [part[n].to_numpy(float)[order] for n in names]
        step = max(1, min(_SUMS_AT_ONCE // max(1, len(own) * len(names)), _SUMS_AT_ONCE // len(part), replicates))
        for lo in range(0, replicates, step):
            r = np.arange(lo, min(lo + step, replicates))
            w = (hash_draws(seed, r, ids) < included).astype(float) if included is not None else poisson_weights(seed, r, ids)
            w = w[:, order]
            sums = [np.add.reduceat(w * v, starts, axis=1) for v in values]
            at, column = np.nonzero(np.any([x != 0 for x in sums], axis=0))
            yield pd.DataFrame({"replicate": r[at], **{c: code[column] for c, code in zip(columns, codes, strict=True)}, **{n: x[at, column] for n, x in zip(names, sums, strict=True)}})

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= _ITEMS_AT_ONCE:
            yield from summed()
            held.clear()
    if sum(map(len, held)):
        yield from summed()


def bootstrap_sums(frame: DataFrame, columns: Sequence[str], terms: dict[str, Column], replicates: int, seed: int, included: float | None = None) -> DataFrame:
    """replicate, the cell's codes (`columns`, whole numbers) and weighted sums of `terms`. Weights are per item."""
    keyed = frame.select(item_key(frame).alias("_item"), *[F.col(c).cast("int").alias(c) for c in columns], *[c.cast("double").alias(n) for n, c in terms.items()])
    run = partial(_weighted, replicates=replicates, seed=seed, columns=list(columns), included=included)
    types = ", ".join([*(f"{c} int" for c in columns), *(f"{v} double" for v in terms)])
    return keyed.mapInPandas(run, f"replicate int, {types}").groupBy("replicate", *columns).agg(*[F.sum(v).alias(v) for v in terms])


def _in_lanes(frame: pd.DataFrame, columns: Sequence[str], names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray], dict[str, np.ndarray]]:
    """The replicates of a block, its cells' codes, and the sums with a row for each replicate and a column for each cell."""
    own, lane = np.unique(frame["replicate"].to_numpy(), return_inverse=True)
    cell, codes = _joint([frame[c].to_numpy(np.int64) for c in columns]) if columns else (np.zeros(len(frame), np.int64), [])
    sums = {}
    for name in names:
        sums[name] = np.zeros((len(own), int(cell.max(initial=-1)) + 1))
        sums[name][lane, cell] = frame[name]
    return own, codes, sums


def _blocks(sums: DataFrame, cells: int) -> DataFrame:
    """The sums with the block of replicates that one task solves together."""
    return sums.withColumn("_block", F.floor(F.col("replicate") / max(1, min(_REPLICATES_AT_ONCE, _LANE_CELLS // max(1, cells)))))


def bootstrap_shift(
    item_fit: DataFrame, items: DataFrame, replicates: int = 2000, seed: int = 0xDD1, controls: Sequence[str] = ("category", "truth"), focal: str = "V-VI", reference: str = "I-II"
) -> DataFrame:
    """replicate, delta: the item bootstrap, with the residuals fitted again in each replicate."""
    frame = item_fit.select("item_id", "b").join(items, "item_id").where("b IS NOT NULL")
    group = F.when(F.col("grp") == focal, 1).when(F.col("grp") == reference, 0).otherwise(-1)
    frame = Scratch(frame.sparkSession, "bootstrap").table(frame.withColumn("_g", group), "frame")
    controls, numeric = split_features(frame, controls)
    scaled, terms = with_moments(frame, numeric, "b")
    coded = Coded(scaled, controls, numeric)
    columns, names = [*coded.columns, "_g"], list(terms)
    n_cells = coded.frame.select(*columns).distinct().count()
    sums = _blocks(bootstrap_sums(coded.frame, columns, terms, replicates, seed), n_cells)
    spans, n_terms, k = coded.spans, coded.terms, len(numeric)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        own, codes, found = _in_lanes(frame, columns, names)
        x = Lanes(codes[:-1], spans, n_terms, k)
        beta = x.least_squares(found)
        resid = found["s"] - found["n"] * x.fitted(beta)
        for i in range(k):
            resid = resid - beta[:, x.first_numeric + i, None] * found[f"z{i}"]
        n = [found["n"][:, codes[-1] == g].sum(1) for g in (1, 0)]
        with np.errstate(invalid="ignore", divide="ignore"):
            delta = resid[:, codes[-1] == 1].sum(1) / n[0] - resid[:, codes[-1] == 0].sum(1) / n[1]
        return pd.DataFrame({"replicate": own, "delta": pd.array(delta, dtype="Float64")})

    return sums.groupBy("_block").applyInPandas(solve, "replicate int, delta double").withColumn("delta", F.when(~F.isnan("delta"), F.col("delta")))


def interval(replicates: DataFrame, value: str = "delta") -> DataFrame:
    """The 2.5 and 97.5 percentiles, by linear interpolation."""
    return replicates.agg(F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"))


def decision(delta: Column, low: Column, high: Column, threshold: Column) -> Column:
    """non_invariance: at least the threshold and an interval without 0; no_effect: neither; else indeterminate."""
    apart, large = (low > 0) | (high < 0), F.abs(delta) >= threshold
    return F.when(apart & large, "non_invariance").when(~apart & ~large, "no_effect").otherwise("indeterminate")


def decide(shift: DataFrame, threshold: float = 0.5, sensitivity: Sequence[float] = (0.3, 0.7)) -> DataFrame:
    """A row for the threshold and each sensitivity threshold. shift: delta, ci_low, ci_high."""
    levels = shift.withColumn("threshold", F.explode(F.lit([float(threshold), *map(float, sensitivity)])))
    return levels.withColumn("decision", decision(F.col("delta"), F.col("ci_low"), F.col("ci_high"), F.col("threshold")))


def fit_lltm(item_fit: DataFrame, items: DataFrame, features: Sequence[str], replicates: int = 2000, seed: int = 0xDD3, spec: str = "") -> DataFrame:
    """spec, term, beta, ci_low, ci_high, r2 of difficulty on features; intervals by the item bootstrap (none with 0 replicates).

    String and boolean features are factors; numeric ones enter as z scores. Where terms determine each other, the coefficients are the least ones
    (see `lanes`), however many there are.
    """
    frame = item_fit.select("item_id", "b").join(items, "item_id").where("b IS NOT NULL")
    frame = Scratch(frame.sparkSession, "lltm").table(frame, "frame")
    factors, numeric = split_features(frame, features)
    scaled, terms = with_moments(frame, numeric, "b")
    coded = Coded(scaled, factors, numeric)
    cells = cells_of(coded, terms, "b", "lltm")
    beta, _, r2 = Equations(coded, cells).solve()
    point = coded.named(beta).select(F.lit(spec).alias("spec"), "term", "beta", F.lit(r2).cast("double").alias("r2"))
    if not replicates:
        return point.select("spec", "term", "beta", F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"), "r2")
    columns, names, spans, n_terms, k = coded.columns, list(terms), coded.spans, coded.terms, len(numeric)
    sums = _blocks(bootstrap_sums(coded.frame, columns, terms, replicates, seed), max(cells.count(), n_terms))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        _, codes, found = _in_lanes(frame, columns, names)
        beta = Lanes(codes, spans, n_terms, k).least_squares(found)
        return pd.DataFrame({"term_no": np.tile(np.arange(n_terms), len(beta)), "beta": beta.ravel()})

    drawn = sums.groupBy("_block").applyInPandas(solve, "term_no long, beta double")
    bounds = drawn.groupBy("term_no").agg(F.percentile("beta", F.lit(0.025)).alias("ci_low"), F.percentile("beta", F.lit(0.975)).alias("ci_high"))
    return point.join(bounds.join(coded.names, "term_no"), "term").select("spec", "term", "beta", "ci_low", "ci_high", "r2")


#: The nesting of difficulty models (fixed values).
NESTING = (("M0", ()), ("M1", ("category",)), ("M2", ("category", "truth")), ("M3", ("category", "truth", "grp")), ("M_raw", ("grp",)))


def nested_r2(item_fit: DataFrame, items: DataFrame, specs: Sequence[tuple[str, Sequence[str]]] = NESTING) -> DataFrame:
    """spec, r2, delta_r2 (over the spec before) and number of terms; a spec without features has r2 0 and no terms.

    One pass counts the finest cells; each spec takes its own rows and columns of their normal equations.
    """
    frame = item_fit.select("item_id", "b").join(items, "item_id").where("b IS NOT NULL")
    every, numeric = split_features(frame, sorted({f for _, fs in specs for f in fs}))
    scaled, terms = with_moments(Scratch(frame.sparkSession, "nested").table(frame, "frame"), numeric, "b")
    coded = Coded(scaled, every, numeric)
    equations = Equations(coded, cells_of(coded, terms, "b", "nested"))
    rows, before = [], None
    for place, (name, features) in enumerate(specs):
        r2, n_terms = 0.0, 0
        if features:
            _, used, r2 = equations.solve(features)
            n_terms = int(used.sum())
        rows.append((place, name, r2, None if before is None or r2 is None else r2 - before, n_terms))
        before = r2
    return item_fit.sparkSession.createDataFrame(rows, "place int, spec string, r2 double, delta_r2 double, n_terms int").drop("place")


def _by_model(frame: pd.DataFrame, factors: Sequence[str], replicates: int, seed: int, least: int) -> pd.DataFrame:
    """The logistic regression of one respondent's cells (the factors, n and right): the point fit where `block` is negative, else
    the coefficients of a block of replicates."""
    model, block = frame["model_id"].iloc[0], int(frame["block"].iloc[0])
    columns = ["model_id", "replicate", "term", "beta", "n", "accuracy", "converged", "skipped"]
    frame = frame.sort_values(list(factors), ignore_index=True)
    n, right = frame["n"].to_numpy(float), frame["right"].to_numpy(float)
    total = int(n.sum())
    if total < least or right.sum() in (0, total):
        reason = "few_answers" if total < least else "degenerate_accuracy"
        return pd.DataFrame([[model, -1, None, None, total, right.sum() / max(total, 1), None, reason]] if block < 0 else [], columns=columns)
    x, names = _local_design(frame, factors)
    beta, converged = x.logistic(n[None], right[None])
    if block < 0:
        return pd.DataFrame([[model, -1, t, b, total, right.sum() / total, bool(converged[0]), None] for t, b in zip(names, beta[0], strict=True)], columns=columns)
    # drawing rows with replacement is drawing counts of (cell, outcome) from a multinomial
    seeded, size = np.random.default_rng([seed, block, *map(ord, str(model))]), min(_REPLICATES_AT_ONCE, replicates - block * _REPLICATES_AT_ONCE)
    drawn = seeded.multinomial(total, np.concatenate([right, n - right]) / total, size=size).astype(float)
    hits = drawn[:, : len(n)]
    usable = np.flatnonzero((hits.sum(1) > 0) & (hits.sum(1) < total))
    step, own = max(1, _LANE_CELLS // len(n)), [np.zeros((0, len(names)))]
    for lo in range(0, len(usable), step):
        at = usable[lo : lo + step]
        own.append(x.logistic(hits[at] + drawn[at, len(n) :], hits[at], beta[0] if converged[0] else None)[0])
    replicates = np.repeat(block * _REPLICATES_AT_ONCE + usable, len(names)).tolist()
    rows = zip(replicates, names * len(usable), np.concatenate(own).ravel().tolist(), strict=True)
    return pd.DataFrame([[model, r, t, b, None, None, None, None] for r, t, b in rows], columns=columns)


def _local_design(frame: pd.DataFrame, factors: Sequence[str]) -> tuple[Lanes, list[str]]:
    """The design of one respondent's cells: group I-II and the most frequent category are references."""
    first: dict[str, object] = {"grp": "I-II"}
    if "category" in factors:
        by_level = frame.groupby("category")["n"].sum()
        first["category"] = by_level[by_level == by_level.max()].index.min()
    names, codes, spans = ["(intercept)"], [], []
    for f in factors:
        text = frame[f].astype(str)
        levels = sorted(text.unique())
        reference = str(first[f]) if f in first else levels[0]
        kept = [level for level in levels if level != reference]
        place = {level: len(names) + i for i, level in enumerate(kept)}
        codes.append(text.map(place).fillna(-1).to_numpy(np.int64))
        spans.append((len(names), len(names) + len(kept)))
        names += [f"{f}_{level}" for level in kept]
    return Lanes(codes, spans, len(names)), names


def logistic_by_model(
    answers: DataFrame, replicates: int = 2000, seed: int = 0xDD9, least: int = 20, factors: Sequence[str] = ("truth", "category", "grp")
) -> DataFrame:
    """Per respondent, logit(right) on truth, category (reference: its most frequent) and group (reference: I-II).

    Answers are counted by cell before a respondent's cells meet; its replicates are drawn in blocks by several tasks. Intervals are
    NULL with fewer than 50 usable replicates.
    """
    counted = answers.where("y IS NOT NULL").groupBy("model_id", *factors).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("right"))
    blocks = F.explode(F.sequence(F.lit(-1), F.lit(-(-replicates // _REPLICATES_AT_ONCE) - 1))) if replicates else F.lit(-1)
    cells = Scratch(answers.sparkSession, "logistic").table(counted, "cells").withColumn("block", blocks)
    schema = "model_id string, replicate int, term string, beta double, n long, accuracy double, converged boolean, skipped string"
    fits = cells.groupBy("model_id", "block").applyInPandas(lambda f: _by_model(f, factors, replicates, seed, least), schema)
    point = lambda c: F.max(F.when(F.col("replicate") < 0, F.col(c))).alias(c)
    drawn = F.when(F.col("replicate") >= 0, F.col("beta"))
    bound = lambda p: F.when(F.count(drawn) >= 50, F.percentile(drawn, F.lit(p)))
    return fits.groupBy("model_id", "term").agg(
        point("beta"), bound(0.025).alias("ci_low"), bound(0.975).alias("ci_high"), point("n"), point("accuracy"), point("converged"), point("skipped")
    )


def pooled_logistic(
    answers: DataFrame,
    replicates: int = 2000,
    seed: int = 0xDDB,
    focal: str = "V-VI",
    reference: str = "I-II",
    controls: Sequence[str] = ("truth", "category", "model_id"),
) -> DataFrame:
    """logit(right) on focal group, truth, category and respondent over two groups; the focal coefficient with an item bootstrap."""
    rows = answers.where(F.col("y").isNotNull() & F.col("grp").isin(focal, reference)).withColumn("focal", (F.col("grp") == focal).cast("int"))
    factors = ["focal", *controls]
    frame = Scratch(answers.sparkSession, "pooled").table(rows.select("item_id", "model_id", *[f for f in factors if f != "model_id"], F.col("y").cast("double").alias("y")), "frame")
    terms = {"n": F.lit(1.0), "s": F.col("y")}
    most = {"focal": "0", "truth": "False"}
    for f in {"category", "model_id"} & set(factors):
        found = frame.groupBy(F.col(f).cast("string").alias("v")).count().agg(F.min(F.struct(-F.col("count"), F.col("v"))).alias("m")).first().m
        most[f] = found[1] if found and found[1] is not None else "None"
    coded = Coded(frame, factors, first=most)
    cells = cells_of(coded, terms, "y", "pooled")
    n_cells = cells.count()
    beta, converged = _logistic(coded, cells, n_cells)
    at, columns, spans, n_terms = coded.spans[0][0], coded.columns, coded.spans, coded.terms
    sizes = frame.agg(F.count(F.lit(1)), F.count_distinct("item_id"), F.count_distinct("model_id")).first()
    known = coded.spans[0][1] > at  # both groups are there
    out = answers.sparkSession.createDataFrame([(float(beta[at]) if known else None, bool(converged), *sizes)], "beta double, converged boolean, n_obs long, n_items long, n_models int")
    if not replicates or not known:
        return out.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double"), "n_success": F.lit(0)})
    sums, start = _blocks(bootstrap_sums(coded.frame, columns, terms, replicates, seed), n_cells), beta if converged else None

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        _, codes, found = _in_lanes(frame, columns, ("n", "s"))
        n, s = found["n"], found["s"]
        usable = (s.sum(1) > 0) & (s.sum(1) < n.sum(1))
        return pd.DataFrame({"beta": Lanes(codes, spans, n_terms).logistic(n[usable], s[usable], start)[0][:, at]})

    drawn = sums.groupBy("_block").applyInPandas(solve, "beta double")
    n_ok = F.count("beta")
    q = lambda p: F.when(n_ok >= 100, F.percentile("beta", F.lit(p)))
    return out.crossJoin(drawn.agg(q(0.025).alias("ci_low"), q(0.975).alias("ci_high"), n_ok.alias("n_success")))  # one row by one row


def _alone(batches: Iterator[pa.RecordBatch], columns: Sequence[str], spans, terms: int) -> Iterator[pa.RecordBatch]:
    data = _arrays(batches, [*columns, "n", "s"])
    beta, converged = Lanes([data[c] for c in columns], spans, terms).logistic(data["n"][None], data["s"][None])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, terms)), pa.array(np.append(float(converged[0]), beta[0]))], ["at", "value"])


def _newton(batches: Iterator[pa.RecordBatch], columns: Sequence[str], spans, terms: int, cap: float, shared) -> Iterator[pa.RecordBatch]:
    """A task's part of a Newton step at given coefficients. Each level of the largest factor is in one task, so it is eliminated here.

    Without the other terms' step: the reduced system, its right side, the objective and the largest fitted value. With it: the levels' own steps.
    """
    beta, move = shared.value
    data = _arrays(batches, [*columns, "n", "s"])
    if not len(data["n"]):
        return
    big = int(np.argmax([b - a for a, b in spans]))
    q = terms - 1 - (spans[big][1] - spans[big][0])
    order = np.argsort(data[columns[big]], kind="stable")
    edges = np.flatnonzero(np.diff(data[columns[big]][order])) + 1
    per = max(1, _LEVEL_NUMBERS // (q + 1))
    cuts = [0, *edges[per - 1 :: per].tolist(), len(order)]
    system, right, levels, steps, most = np.zeros((q, q)), np.zeros(q), [], [], 0.0
    value = 0.0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        at = order[lo:hi]
        lanes = Lanes([data[c][at] for c in columns], spans, terms)
        n, s = data["n"][at][None], data["s"][at][None]
        eta = lanes.fitted(beta[None])
        p = 1 / (1 + np.exp(-np.clip(eta, -cap, cap)))
        _, own, d, md, b, c, m = lanes.blocks({"n": n * p * (1 - p), "s": s - n * p})
        inverse = np.where(d[0] > 0, 1 / np.where(d[0] > 0, d[0], 1), 0)
        if move is not None:
            levels.append(own)
            steps.append(inverse * (md[0] - b[0] @ move))
            continue
        weighted = b[0] * inverse[:, None]
        system += c[0] - weighted.T @ b[0]
        right += m[0] - weighted.T @ md[0]
        value += float((s * eta - n * np.logaddexp(0, eta)).sum())
        most = max(most, float(np.abs(eta).max()))
    if move is not None:
        at = np.concatenate(levels)
        yield from _sparse(np.where(at < 0, 0, at), np.concatenate(steps))
    else:
        yield from _sparse(np.arange(q * q + q + 1), np.concatenate([system.ravel(), right, [value]]))
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([most])], ["at", "value"])


def _logistic(coded: Coded, cells: DataFrame, n_cells: int, cap: float = 15.0, rounds: int = 50) -> tuple[np.ndarray, bool]:
    """Maximum likelihood over a table of cells: few cells are fitted by one task; many are dealt by the level of the largest factor, which
    each task eliminates for its own levels, and the driver solves for the other terms' step."""
    spans, terms, columns = coded.spans, coded.terms, coded.columns
    if n_cells <= _CELLS_A_TASK:
        found = cells.coalesce(1).mapInArrow(partial(_alone, columns=columns, spans=spans, terms=terms), "at long, value double").toArrow()
        values = found.column("value").to_numpy()
        return values[1:], bool(values[0])
    big = int(np.argmax([b - a for a, b in spans]))
    a, z = spans[big]
    others = np.r_[1:a, z:terms]
    q, context = len(others), cells.sparkSession.sparkContext
    parts = cells.repartition(columns[big]).persist()

    def job(beta: np.ndarray, move: np.ndarray | None) -> tuple[np.ndarray, float]:
        shared = context.broadcast((beta, move))
        run = partial(_newton, columns=columns, spans=spans, terms=terms, cap=cap, shared=shared)
        found = parts.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"), F.max("value").alias("most")).toArrow()
        shared.destroy()
        at, value = found.column("at").to_numpy(), found.column("value").to_numpy()
        out = np.zeros(terms if move is not None else q * q + q + 1)
        out[at[at >= 0]] = value[at >= 0]
        return out, float(found.column("most").to_numpy()[at < 0].max(initial=0))

    try:
        beta, before, step = np.zeros(terms), None, None
        for _ in range(4 * rounds):
            found, most = job(beta, None)
            value = found[-1]
            if before is not None and value < before and np.abs(step).max(initial=0) > 1e-9:
                step = step / 2  # back half the way
                beta = beta - step
                continue
            if most >= cap:
                return beta, False
            if before is not None and abs(value - before) < 1e-10 * (abs(before) + 1):
                return beta, True
            before = value
            move = least_solution(found[: q * q].reshape(q, q), found[q * q : -1])
            own, _ = job(beta, move)
            step = np.zeros(terms)
            step[others] = move
            step[0] = own[0]
            step[a:z] = own[a:z] - own[0]
            beta = beta + step
        return beta, False
    finally:
        parts.unpersist()


def matched_gap_bootstrap(answers: DataFrame, replicates: int = 2000, seed: int = 0xDDB, focal: str = "V-VI", reference: str = "I-II") -> DataFrame:
    """replicate, gap over matched categories, where each replicate takes a *set* of items.

    An item is in with the probability that n draws hit it, 1 - (1 - 1/n)^n, by its own hash draw.
    """
    two = answers.where(F.col("y").isNotNull() & F.col("grp").isin(focal, reference))
    both = two.groupBy("category").agg(F.count_distinct("grp").alias("k")).where("k = 2").select("category")
    by_item = two.join(F.broadcast(both), "category", "left_semi").groupBy("item_id", "grp").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("right"))
    by_item = Scratch(answers.sparkSession, "matched-gap").table(by_item, "items")
    items = by_item.count()
    share = 1 - (1 - 1 / items) ** items if items else 1.0
    sums = bootstrap_sums(by_item.withColumn("_g", (F.col("grp") == reference).cast("int")), ["_g"], {"n": F.col("n"), "right": F.col("right")}, replicates, seed, included=share)
    of = lambda c, v: F.sum(F.when(F.col("_g") == c, F.col(v)))
    return sums.groupBy("replicate").agg((of(0, "right") / of(0, "n") - of(1, "right") / of(1, "n")).alias("gap"))


def refusal_logit(cells: DataFrame, items: DataFrame, registry: DataFrame, replicates: int = 2000, seed: int = 0xDD6) -> DataFrame:
    """term, beta, ci_low, ci_high of logit(refused) on group, with a bootstrap over respondents.

    With one factor the optimum is known: differences of log odds between groups. Items nobody was asked count as not refused.
    A fit where a group has all or no refusals is NULL. Draws of respondents are made in the tasks and join their few counts by group.
    """
    spark = cells.sparkSession
    sizes = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    models = [r[0] for r in registry.select("id").distinct().orderBy("id").collect()]
    refused = cells.where("refused").join(items.select("item_id", "grp"), "item_id").groupBy("model_id", "grp").agg(F.count(F.lit(1)).alias("r"))
    panel = spark.createDataFrame([(i, m) for i, m in enumerate(models)], "at int, model_id string")
    counts = F.broadcast(panel.crossJoin(sizes).join(refused, ["model_id", "grp"], "left").select("at", "grp", "n", F.coalesce("r", F.lit(0)).alias("r")))
    j = len(models)
    turns = spark.range(-1, replicates).select(F.col("id").cast("int").alias("replicate"), F.explode(F.lit(list(range(j)) or None)).alias("turn"))
    seat = F.least(F.floor(hash_draw(seed, F.col("replicate"), F.col("turn")) * j), F.lit(j - 1)).cast("int")
    drawn = turns.select("replicate", F.when(F.col("replicate") < 0, F.col("turn")).otherwise(seat).alias("at")).join(counts, "at")
    odds = drawn.groupBy("replicate", "grp").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    logit = F.when((F.col("r") > 0) & (F.col("r") < F.col("n")), F.log(F.col("r") / (F.col("n") - F.col("r"))))
    levels = odds.select("replicate", "grp", logit.alias("l"))
    first = items.agg(F.min("grp")).first()[0]
    base = levels.where(F.col("grp") == first).select("replicate", F.col("l").alias("base"))
    terms = levels.join(base, "replicate").select("replicate", F.when(F.col("grp") == first, "(intercept)").otherwise(F.concat(F.lit("grp_"), "grp")).alias("term"), F.when(F.col("grp") == first, F.col("l")).otherwise(F.col("l") - F.col("base")).alias("beta"))
    of = F.when(F.col("replicate") >= 0, F.col("beta"))
    return terms.groupBy("term").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("beta"))).alias("beta"), F.percentile(of, F.lit(0.025)).alias("ci_low"), F.percentile(of, F.lit(0.975)).alias("ci_high")
    )


def folds(items: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds fold: items of each class dealt in turn, in the order of a seeded hash. Items are numbered in buckets of the hash."""
    from plumbline.functions.text import unit_hash
    from plumbline.plans.ranks import gapless_rank

    keyed = items.withColumn("_h", unit_hash(F.lit(str(seed)), F.col("item_id").cast("string")))
    ranked = gapless_rank(keyed, ["truth"], F.shiftright("_h", 24), [F.col("_h"), F.col("item_id")], "_r")
    return ranked.withColumn("fold", (F.col("_r") % k).cast("int")).drop("_h", "_r")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _fold_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fold: rows, sums and sums of squares of each dimension, by position."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        x, fold = _matrix(batch.column("embedding")), batch.column("fold").to_numpy()
        for f in np.unique(fold):
            own = x[fold == f]
            part = np.concatenate([[len(own)], own.sum(0), (own * own).sum(0)])
            total[int(f)] = total.get(int(f), 0) + part
    for f, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), f, np.int32)), pa.array(np.arange(len(part))), pa.array(part)], ["fold", "at", "value"])


def _probe_sums(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Losses and gradients of all lanes' probes: one product of the rows with all weights, where a fold's rows don't count for its own lane."""
    lanes, weights, bias = shared.value  # weights of the raw dimensions, a column for each lane
    total = np.zeros((len(weights) + 2, len(lanes)))
    for batch in batches:
        x, fold, y = _matrix(batch.column("embedding")), batch.column("fold").to_numpy(), batch.column("label").to_numpy()
        used = fold[:, None] != lanes[None, :]
        z = x @ weights + bias
        error = np.where(used, 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[:, None], 0)
        total[0] += np.where(used, np.logaddexp(0, z) - y[:, None] * z, 0).sum(0)
        total[1] += error.sum(0)
        total[2:] += x.T @ error
    yield from _sparse(np.arange(total.size), total.ravel())


def probe_predictions(frame: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """item_id, fold, truth, predicted of items with embedding and fold, each by its own fold's probe (a column of `weights`)."""
    shared = frame.sparkSession.sparkContext.broadcast((weights, bias))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch.column("embedding")), batch.column("fold").to_numpy()
            z = np.einsum("ij,ji->i", x, shared.value[0][:, fold]) + shared.value[1][fold] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item_id", "fold", "truth")), pa.array(z > 0)], ["item_id", "fold", "truth", "predicted"])

    kinds = dict(frame.dtypes)
    return frame.select("item_id", "fold", "truth", "embedding").mapInArrow(judged, f"item_id {kinds['item_id']}, fold int, truth boolean, predicted boolean")


def fit_probes(frame: DataFrame, k: int, c: float = 1.0, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dimensions by folds) and biases of the L2 logistic probes that leave out one fold each, all trained in the same scans.

    frame: fold, label, embedding. Each is standardised by its own rows: the sums of all folds less those of its own.
    """
    spark = frame.sparkSession
    found = frame.select("fold", "embedding").mapInArrow(_fold_moments, "fold int, at long, value double").groupBy("fold", "at").agg(F.sum("value").alias("value")).toArrow()
    fold, at, value = (found.column(n).to_numpy() for n in ("fold", "at", "value"))
    size = int(at.max(initial=0)) + 1
    moments = np.zeros((k, size))
    moments[fold, at] = value
    rest = moments.sum(0) - moments
    dims, n = (size - 1) // 2, np.maximum(rest[:, :1], 1)
    mean = rest[:, 1 : dims + 1] / n
    variance = np.maximum(rest[:, dims + 1 :] - n * mean * mean, 0) / np.maximum(n - 1, 1)
    scale = np.where(variance > 1e-24, 1 / np.sqrt(np.where(variance > 1e-24, variance, 1)), 0)

    def raw(lanes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = vectors[:, :dims] * scale[lanes]
        return w.T, vectors[:, dims] - (w * mean[lanes]).sum(1)

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        lanes = np.array(list(points))
        vectors = np.array([points[i] for i in lanes])
        shared = spark.sparkContext.broadcast((lanes, *raw(lanes, vectors)))
        total = _collected(frame.select("fold", "label", "embedding").mapInArrow(partial(_probe_sums, shared=shared), "at long, value double"), (dims + 2) * len(lanes)).reshape(dims + 2, len(lanes))
        shared.destroy()
        out = {}
        for i, lane in enumerate(lanes.tolist()):
            w = vectors[i, :dims]
            slope = scale[lane] * (total[2:, i] - mean[lane] * total[1, i]) + w / c
            out[lane] = float(total[0, i] + w @ w / (2 * c)), np.append(slope, total[1, i])
        return out

    best = np.array([x for x, _ in minimise_together(evaluate, [np.zeros(dims + 1)] * k, max_iter, tol=1e-10)])
    return raw(np.arange(k), best)


def crossfit_probe(embeddings: DataFrame, items: DataFrame, k: int = 5, c: float = 1.0, seed: int = 0) -> DataFrame:
    """item_id, fold, truth, predicted and an answer text that the parser reads: out-of-fold labels of an L2 logistic probe.

    Each fold's probe is standardised and trained on the other folds; all folds' probes share their scans.
    """
    frame = folds(items.join(embeddings, "item_id").select("item_id", "truth", "embedding"), k, seed)
    frame = Scratch(frame.sparkSession, "probe").table(frame.select("item_id", "fold", "truth", F.col("truth").cast("double").alias("label"), "embedding"), "frame")
    out = probe_predictions(frame, *fit_probes(frame, k, c))
    return out.withColumn("raw_text", F.concat(F.lit("Answer: "), F.when(F.col("predicted"), "malignant").otherwise("benign")))
