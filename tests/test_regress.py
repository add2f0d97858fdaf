"""Regressions: text identifiers, numeric features, many levels and cells, and hash draws in Spark and in NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import lanes as lanes_module
from plumbline.functions.kernels import hash_draw, hash_draws
from plumbline.functions.lanes import Lanes, least_solution
from plumbline.operators import regress


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{i:06}.png", f"c{rng.integers(6)}", bool(rng.random() < 0.4), ["I-II", "III-IV", "V-VI"][int(rng.integers(3))], float(rng.normal(3, 5)), int(rng.integers(10)), float(rng.normal())) for i in range(400)]
    schema = "item_id string, category string, truth boolean, grp string, age double, shade int, b double"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    answers = spark.createDataFrame([(f"m{m}", r[0], *r[1:4], int(rng.random() < 0.3 + 0.1 * m)) for m in range(3) for r in rows], "model_id string, item_id string, category string, truth boolean, grp string, y int")
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), frame.select("item_id", "b"), frame.drop("b"), answers


def _matrix(table, factors, numeric):
    columns, names = [np.ones(len(table))], ["(intercept)"]
    for f in factors:
        for level in sorted(table[f].astype(str).unique())[1:]:
            columns.append((table[f].astype(str) == level).to_numpy(float))
            names.append(f"{f}_{level}")
    for f in numeric:
        columns.append(((table[f] - table[f].mean()) / table[f].std(ddof=0)).to_numpy())
        names.append(f)
    return np.column_stack(columns), names


@pytest.mark.parametrize(("factors", "numeric"), [((), ("age",)), (("category", "truth"), ("age", "shade")), (("grp",), ()), (("category", "truth", "grp"), ("shade",))])
def test_numeric_features_enter_as_z_scores(panel, factors, numeric):
    table, fit, items, _ = panel
    x, names = _matrix(table, factors, numeric)
    want = np.linalg.lstsq(x, table["b"], rcond=None)[0]
    got = regress.fit_lltm(fit, items, [*factors, *numeric], replicates=60).toPandas().set_index("term")
    assert np.allclose(got.loc[names, "beta"], want)
    left = table["b"] - x @ want
    assert got["r2"].iloc[0] == pytest.approx(1 - (left @ left) / ((table["b"] - table["b"].mean()) ** 2).sum())
    assert (got["ci_low"] < got["beta"]).all() and (got["beta"] < got["ci_high"]).all()
    resid = regress.residualize(fit, items, [*factors, *numeric]).select("item_id", "resid").toPandas().set_index("item_id")
    assert np.allclose(resid.loc[table["item_id"], "resid"], left)
    nested = regress.nested_r2(fit, items, [("none", ()), ("own", (*factors, *numeric)), ("two", ("grp", "age"))]).toPandas().set_index("spec")
    assert nested.loc["own", "r2"] == pytest.approx(got["r2"].iloc[0]) and nested.loc["own", "n_terms"] == len(names) and nested.loc["two", "n_terms"] == 4


def test_bootstraps_take_text_identifiers(panel):
    _, fit, items, answers = panel
    shift = regress.bootstrap_shift(fit, items, replicates=80, controls=("category", "truth", "age")).toPandas()
    assert len(shift) == 80 and shift["delta"].std() > 0
    pooled = regress.pooled_logistic(answers, replicates=120).first()
    assert pooled.n_success == 120 and pooled.ci_low < pooled.beta < pooled.ci_high
    gap = regress.matched_gap_bootstrap(answers, replicates=50).toPandas()
    assert len(gap) == 50 and gap["gap"].std() > 0


def test_replicates_do_not_depend_on_how_they_are_cut(panel, monkeypatch):
    _, fit, items, _ = panel
    want = {r.replicate: r.delta for r in regress.bootstrap_shift(fit, items, replicates=50).collect()}
    names = ["item_id", "cell", "one"]
    frames = [pd.DataFrame({"_item": np.arange(k, k + 70), "cell": np.arange(70) % 9, "n": 1.0, "s": np.arange(70) * 0.1}) for k in (0, 70, 140)]
    sums = lambda: pd.concat(regress._weighted(iter(frames), 40, 3, ["cell"], None)).groupby(["replicate", "cell"])[["n", "s"]].sum()
    whole = sums()
    monkeypatch.setattr(regress, "_SUMS_AT_ONCE", 50)
    monkeypatch.setattr(regress, "_ITEMS_AT_ONCE", 60)
    assert np.allclose(sums(), whole) and len(whole) == 360 and names
    assert {r.replicate: round(r.delta, 9) for r in regress.bootstrap_shift(fit.repartition(7), items, replicates=50).collect()} == {k: round(v, 9) for k, v in want.items()}


def _random_lanes(rng, trial):
    """A design over random cells with aliased factors in every third trial, and weights that leave levels out."""
    cells, levels = int(rng.integers(3, 80)), [int(rng.integers(1, 12)) for _ in range(int(rng.integers(1, 4)))]
    raw = [rng.integers(0, n, cells) for n in levels]
    if trial % 3 == 0:
        levels, raw = [*levels, levels[0]], [*raw, raw[0]]
    spans, codes, at = [], [], 1
    for n, r in zip(levels, raw, strict=True):
        spans.append((at, at + n - 1))
        codes.append(np.where(r == 0, -1, at + r - 1))
        at += n - 1
    k = int(rng.integers(0, 3))
    n, y, z = rng.poisson(1.5, (4, cells)).astype(float), rng.normal(size=(4, cells)), rng.normal(size=(k, cells))
    if trial % 5 == 0:
        n[0][raw[0] == 0] = 0
    sums = {"n": n, "s": n * y}
    for i in range(k):
        sums |= {f"z{i}": n * z[i], f"z{i}s": n * z[i] * y} | {f"z{i}z{m}": n * z[i] * z[m] for m in range(i, k)}
    x = np.zeros((cells, at + k))
    x[:, 0] = 1
    for c in codes:
        x[np.flatnonzero(c >= 0), c[c >= 0]] = 1
    x[:, at:] = z.T
    return Lanes(codes, spans, at + k, k), sums, x, n, y


@pytest.mark.parametrize("direct", [64, -1])
def test_every_way_of_solving_gives_the_least_solution(monkeypatch, direct):
    monkeypatch.setattr(lanes_module, "_DIRECT", direct)
    rng = np.random.default_rng(5)
    for trial in range(45):
        lanes, sums, x, n, y = _random_lanes(rng, trial)
        beta = lanes.least_squares(sums)
        for r in range(len(n)):
            want = least_solution(x.T @ (x * n[r][:, None]), x.T @ (n[r] * y[r]))
            assert np.allclose(x.T @ (n[r] * (x @ beta[r] - y[r])), 0, atol=1e-7)
            assert np.allclose(beta[r], want, atol=1e-6)


def test_the_least_solution_is_the_least():
    """Of all fits alike, none has a smaller sum of squares, each times its column's."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1], 2 * x[:, 2]])
    gram, y = x.T @ x, rng.normal(size=30)
    beta = least_solution(gram, x.T @ y)
    root = np.sqrt(np.diag(gram))
    want = np.linalg.pinv(x / root) @ y / root
    assert np.allclose(beta, want) and np.allclose(x.T @ (x @ beta - y), 0, atol=1e-9)


def test_many_lanes_of_many_terms_are_quick():
    import time

    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1490, 6000), rng.integers(0, 8, 6000)
    lanes = Lanes([np.where(a == 0, -1, a), np.where(b == 0, -1, 1489 + b)], [(1, 1490), (1490, 1497)], 1497)
    n, began = rng.poisson(1, (2000, 6000)).astype(float), time.time()
    assert lanes.least_squares({"n": n, "s": n * rng.normal(size=6000)}).shape == (2000, 1497) and time.time() - began < 60


def test_logistic_lanes_are_single_fits():
    rng = np.random.default_rng(8)
    a, b = np.repeat(np.arange(12), 3), np.tile(np.arange(3), 12)
    lanes = Lanes([np.where(a == 0, -1, a), np.where(b == 0, -1, 11 + b)], [(1, 12), (12, 14)], 14)
    n = rng.integers(5, 40, (6, 36)).astype(float)
    right = rng.binomial(n.astype(int), 0.4).astype(float)
    n[5], right[5] = 10, np.where(a == 3, 10, 4)  # a separated lane stops, and says so
    beta, converged = lanes.logistic(n, right)
    assert converged.tolist() == [True] * 5 + [False]
    for r in range(5):
        p = 1 / (1 + np.exp(-lanes.fitted(beta[r : r + 1])[0]))
        score = right[r] - n[r] * p
        assert abs(score.sum()) < 1e-6 and all(abs(score[c == t].sum()) < 1e-6 for c in lanes.codes for t in set(c.tolist()))
        alone, _ = lanes.logistic(n[r : r + 1], right[r : r + 1])
        assert np.allclose(beta[r], alone[0], atol=1e-9)


@pytest.fixture
def answered(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"m{m}", f"c{i % 40}", bool(i % 3 == 0), "I-II" if i % 7 < 3 else "V-VI", int(rng.random() < 0.35 + 0.05 * (i % 7 < 3) + 0.1 * m / 5)) for i in range(600) for m in range(5)]
    return spark.createDataFrame(rows, "item_id long, model_id string, category string, truth boolean, grp string, y int").repartition(4)


def test_a_pooled_fit_is_the_same_where_its_cells_are_dealt(answered, monkeypatch):
    plain = regress.pooled_logistic(answered, replicates=0).first()
    monkeypatch.setattr(regress, "_CELLS_A_TASK", 0)
    monkeypatch.setattr(regress, "_LEVEL_NUMBERS", 20)
    dealt = regress.pooled_logistic(answered, replicates=0).first()
    assert dealt.converged and plain.converged and dealt.beta == pytest.approx(plain.beta, abs=1e-6) and dealt.n_obs == plain.n_obs == 3000


def test_a_pooled_fit_over_a_hundred_thousand_categories(spark, monkeypatch):
    monkeypatch.setattr(regress, "_CELLS_A_TASK", 1000)
    rows = spark.range(1_200_000).selectExpr(
        "id % 400000 AS item_id", "concat('m', id % 3) AS model_id", "concat('c', pmod(hash(id % 400000), 100000)) AS category", "id % 400000 % 3 = 0 AS truth",
        "IF(id % 400000 % 7 < 3, 'I-II', 'V-VI') AS grp", "cast(pmod(xxhash64(id), 1000) < 400 + IF(id % 400000 % 7 < 3, 0, 100) AS int) AS y"
    )
    fit = regress.pooled_logistic(rows, replicates=0).first()
    # conditional on a dozen answers a category, the joint estimate is larger than log(0.5/0.5) - log(0.4/0.6) = 0.405 by a tenth or so
    assert fit.n_obs == 1_200_000 and 0.35 < fit.beta < 0.55


def test_two_factors_of_many_levels_are_solved_without_their_equations(panel, monkeypatch):
    """The same coefficients, residuals and shares as from the equations themselves, with aliased factors, too."""
    _, fit, items, _ = panel
    items = items.withColumn("twin", F.concat(F.lit("t"), "category"))
    features = ["category", "truth", "twin", "age"]
    run = lambda: (
        regress.fit_lltm(fit, items, features, replicates=0).toPandas().set_index("term").sort_index(),
        regress.residualize(fit, items, features).select("item_id", "resid").toPandas().set_index("item_id").sort_index(),
        regress.nested_r2(fit, items, [("a", ("category", "age")), ("b", ("grp", "truth"))]).toPandas(),
    )
    want = run()
    monkeypatch.setattr(regress, "_GRAM_TERMS", 0)
    monkeypatch.setattr(regress, "_LEVELS_AT_HAND", 0)
    got = run()
    assert np.allclose(got[0][["beta", "r2"]], want[0][["beta", "r2"]], atol=1e-8) and np.allclose(got[1], want[1], atol=1e-8)
    assert np.allclose(got[2]["r2"], want[2]["r2"], atol=1e-8) and got[2]["n_terms"].tolist() == want[2]["n_terms"].tolist()


def test_two_factors_of_a_hundred_thousand_levels(spark):
    frame = spark.range(600_000).selectExpr(
        "id AS item_id", "concat('c', pmod(hash(id), 100000)) AS category", "concat('s', pmod(xxhash64(id), 100000)) AS source", "IF(id % 7 < 3, 'I-II', 'V-VI') AS grp",
        "sin(id) + pmod(hash(id), 100000) / 50000 - pmod(xxhash64(id), 100000) / 70000 AS b"
    )
    resid = regress.residualize(frame.select("item_id", "b"), frame.drop("b"), ("category", "source"))
    resid = resid.select("category", "source", "resid").persist()
    for f in ("category", "source"):
        assert resid.groupBy(f).agg(F.sum("resid").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-6
    resid.unpersist()


def test_a_hundred_thousand_cells(spark):
    """10,000 levels of one factor: no matrix of cells times levels is made."""
    frame = spark.range(100_000).selectExpr(
        "concat(id, '.png') AS item_id", "concat('c', id % 10000) AS category", "id % 3 = 0 AS truth", "IF(id % 7 < 3, 'I-II', 'V-VI') AS grp", "sin(id) + (id % 10000) / 5000 + IF(id % 3 = 0, 1, 0) AS b"
    )
    fit, items = frame.select("item_id", "b"), frame.drop("b")
    resid = regress.residualize(fit, items, ("category", "truth", "grp"))
    sums = resid.groupBy("category").agg(F.sum("resid").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert sums < 1e-6 and abs(resid.where("truth").agg(F.sum("resid")).first()[0]) < 1e-6
    boot = regress.bootstrap_shift(fit, items, replicates=3).toPandas()
    assert len(boot) == 3 and boot["delta"].abs().max() < 0.1


def test_hash_draws_are_the_same_in_spark(spark):
    frame = spark.range(40).withColumn("item", F.col("id") * 123_456_789)
    got = {r.id: [r[f"u{k}"] for k in range(5)] for r in frame.select("id", *[hash_draw(0xDD6, F.lit(k), F.col("item")).alias(f"u{k}") for k in range(5)]).collect()}
    want = hash_draws(0xDD6, np.arange(5), np.arange(40) * 123_456_789)
    assert all(np.allclose(got[i], want[:, i], atol=0) for i in range(40))
