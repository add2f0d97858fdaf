"""Audit operators on hand-sized cases and by their properties."""

import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels, network
from plumbline.functions.lanes import Lanes
from plumbline.operators import irt, regress, reports, responses, stats, vectors
from plumbline.plans import components, fixtures, queries, ranks, storage
from plumbline.sources import tables

LOG = "model_id string, item_id long, raw_text string, error string, ts long, ord long"


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG)


# -- parsing and dedupe ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "label", "confidence", "reasoning"),
    [
        ("I cannot say", "refusal", None, None),
        ("I cannot be sure.\nANSWER:  Benign", "benign", None, None),
        ("nothing here\nConfidence: low", "unparseable", None, None),
        ("answer:benign", "benign", None, None),
        ("Answer: malignant then Answer: benign", "malignant", None, None),
        ("Answer: benign\nConfidence: HIGH\nReasoning: a\n b \n", "benign", "high", "a\n b"),
        ("", "unparseable", None, None),
        (None, "unparseable", None, None),
        ("Please CONSULT A doctor", "refusal", None, None),
    ],
)
def test_parser(spark, text, label, confidence, reasoning):
    r = responses.parse_answers(_log(spark, [("m", 1, text, None, 0, 0)])).first()
    assert (r.label, r.confidence, r.reasoning, r.used_fallback) == (label, confidence, reasoning, False)


@pytest.fixture(scope="module")
def one_pair(spark):
    texts = [("x", "boom"), ("I cannot", None), ("Answer: benign", None), ("what", None), ("Answer: malignant", None)]
    return _log(spark, [("m", 1, t, e, min(k, 3), k) for k, (t, e) in enumerate(texts)])


def test_three_dedupes(spark, one_pair):
    items = spark.createDataFrame([(1, True)], "item_id long, truth boolean")
    registry = spark.createDataFrame([("m",)], "id string")
    label = lambda d: responses.parse_answers(d).first().label
    assert label(responses.first_success(one_pair)) == "refusal"
    assert label(responses.latest_success(one_pair)) == "malignant"  # of equal timestamps the later row
    r = responses.response_cells(one_pair, items, registry).first()
    assert (r.y, r.refused) == (1, True)


def test_error_policies(spark):
    log = _log(spark, [("m", 1, "a", None, 0, 0), ("m", 2, "b", "", 0, 0), ("m", 3, "c", "quota exceeded", 0, 0)])
    assert responses.drop_errors(log).count() == 1 and responses.drop_errors(log, "truthy").count() == 2
    assert [tuple(r) for r in responses.classify_errors(log).collect()] == [("m", "rate_limit", 1)]
    with pytest.raises(ValueError):
        responses.drop_errors(log, "other")


def test_empty_panel_is_an_error(spark):
    registry = tables.registry(spark, fixtures.registry_rows())
    with pytest.raises(ValueError):
        responses.select_respondents(registry, model_id="nobody")
    cells = spark.createDataFrame([("m", 1, 1, False)], "model_id string, item_id long, y int, refused boolean")
    with pytest.raises(ValueError):
        responses.keep_covered(cells, 2)


def test_unknown_group_code_is_an_error(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("DDI_file,skin_tone,disease,malignant\na,12,x,True\nb,99,y,False\n")
    with pytest.raises(Exception, match="unknown group code 99"):
        tables.read_items(spark, str(path)).collect()


def test_strict_log_fails_on_a_broken_line(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"model_id": "m", "item_id": "1", "raw_text": "t"}\n\n{"model_id": \n')
    assert tables.read_log(spark, str(path)).count() == 1
    with pytest.raises(Exception):
        tables.read_log(spark, str(path), "strict").collect()


def test_saturated_at_no_answers(spark):
    cells = spark.createDataFrame([("m", 1, None), ("m", 2, 1), ("n", 2, 0), ("m", 3, 1)], "model_id string, item_id long, y int")
    assert {r.item_id: r.saturated for r in responses.saturated_items(cells).collect()} == {1: True, 2: False, 3: True}


# -- decisions and NULL rules -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("delta", "low", "high", "want"),
    [(0.5, 0.1, 0.9, "non_invariance"), (-0.5, -0.9, -0.1, "non_invariance"), (0.49, -0.1, 0.9, "no_effect"), (0.6, -0.1, 0.9, "indeterminate"), (0.3, 0.1, 0.5, "indeterminate")],
)
def test_decision(spark, delta, low, high, want):
    shift = spark.createDataFrame([(delta, low, high)], "delta double, ci_low double, ci_high double")
    assert [r.decision for r in regress.decide(shift, 0.5, ()).collect()] == [want]


def test_null_rules(spark):
    one_class = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, p double")
    assert irt.heldout_auc(one_class).first().auc is None
    answers = spark.createDataFrame([("c", "V-VI", 1), ("c", "I-II", 1), ("c", "I-II", 0)], "pair string, grp string, y int")
    r = stats.mantel_haenszel(answers, "pair").first()
    assert r.delta is None and r.chi2 is None and r.p is None
    resid = spark.createDataFrame([("a", 1, 0.2, True), ("b", 1, 0.1, True)], "model_id string, item_id long, resid double, focal boolean")
    assert stats.permutation_test(resid, 50).first().permutation_p is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert stats.spearman(flat, "x", "y").first().rho is None


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.02, 0.03, float("nan"), 0.2, None])], "i int, p double")
    assert {r.i: r.significant for r in stats.benjamini_hochberg(p).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_p_values():
    assert kernels.t_p(0.5, 20) == pytest.approx(0.0247688, abs=1e-6)
    assert kernels.t_p(1.0, 9) == 0 and kernels.t_p(0.2, 2) is None
    assert float(kernels.erfc(np.array([math.sqrt(3.841458821 / 2)]))[0]) == pytest.approx(0.05, abs=1e-9)
    assert kernels.regularised_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


# -- fits ---------------------------------------------------------------------------------------------------


def _simulated(spark, models=8, items=150, seed=0):
    rng = np.random.default_rng(seed)
    theta, b = np.linspace(-1.5, 1.5, models), rng.normal(0.4, 0.8, items)
    y = rng.random((models, items)) < 1 / (1 + np.exp(b[None, :] - theta[:, None]))
    rows = [(f"m{j}", i, int(y[j, i]), False) for j in range(models) for i in range(items) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "model_id string, item_id long, y int, refused boolean"), theta, b


@pytest.fixture(scope="module")
def simulated(spark):
    cells, theta, b = _simulated(spark)
    return responses.prune_saturated(cells).persist(), theta, b


def test_rasch_score_equations(spark, simulated):
    cells, theta, _ = simulated
    item_fit, model_fit = irt.fit_rasch(cells, max_iter=40, tol=1e-8, inner=10)
    scored = irt.cell_probabilities(cells, model_fit, item_fit)
    for key in ("model_id", "item_id"):
        worst = scored.groupBy(key).agg(F.abs(F.sum(F.col("y") - F.col("p"))).alias("e")).agg(F.max("e")).first()[0]
        assert worst < 1e-3
    found = {r.model_id: r.theta for r in model_fit.collect()}
    assert abs(sum(found.values())) < 1e-9 and [found[f"m{j}"] for j in range(8)] == sorted(found.values())
    both = irt.fit_rasch(cells, max_iter=5, anchor="both")[0]
    assert abs(both.agg(F.avg("b")).first()[0]) < 1e-9
    again = irt.fit_rasch(cells.repartition(7), max_iter=40, tol=1e-8, inner=10)[1]
    assert {r.model_id: round(r.theta, 8) for r in again.collect()} == {m: round(t, 8) for m, t in found.items()}


def test_network_gradient():
    rng = np.random.default_rng(1)
    vector, e, slope = network.MLP.initial(5, 4, 3), rng.normal(size=(7, 5)), rng.normal(size=7)
    net = network.MLP(5, 4, vector)
    gradient = net.backward(net.forward(e)[1], slope)
    for i in rng.integers(0, len(vector), 12):
        step = np.zeros(len(vector))
        step[i] = 1e-5
        up, down = (float(slope @ network.MLP(5, 4, vector + s).forward(e)[0]) for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=3e-2)


def test_erf_approximation():
    x = np.linspace(-4, 4, 201)
    assert np.abs(network.erf(x) - [math.erf(v) for v in x]).max() < 1e-6


def test_amortised_fit_follows_the_embedding(spark, simulated):
    cells, theta, b = simulated
    rng = np.random.default_rng(5)
    emb = spark.createDataFrame([(i, [float(v), 1.0, float(z)]) for i, (v, z) in enumerate(zip(b, rng.normal(size=len(b)), strict=True))], "item_id long, embedding array<float>")
    fit = irt.fit_amortized(cells, emb, hidden=8, max_iter=25)
    assert all(a >= z for a, z in zip(fit.history, fit.history[1:], strict=False)) and fit.history[-1] < 0.95 * fit.history[0]
    assert abs(fit.theta.mean()) < 1e-2 and list(fit.theta) == sorted(fit.theta)
    found = irt.score_difficulty(fit, emb).toPandas().sort_values("item_id")["b"]
    assert np.corrcoef(found, b)[0, 1] > 0.9


def test_residuals_and_rank_deficiency(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"c{i % 6}", i % 6 < 2, ["I-II", "V-VI"][i // 6 % 2], float(rng.normal() + i % 6)) for i in range(120)]
    items = spark.createDataFrame([r[:4] for r in rows], "item_id long, category string, truth boolean, grp string")
    fit = spark.createDataFrame([(r[0], r[4]) for r in rows], "item_id long, b double")
    with_truth, without = (regress.residualize(fit, items, c).toPandas().sort_values("item_id")["resid"].to_numpy() for c in (("category", "truth"), ("category",)))
    assert np.allclose(with_truth, without)
    x = np.column_stack([np.ones(120), *[[r[1] == f"c{k}" for r in rows] for k in range(1, 6)]]).astype(float)
    y = np.array([r[4] for r in rows])
    assert np.allclose(without, y - x @ np.linalg.lstsq(x, y, rcond=None)[0])
    r2 = {r.spec: r.r2 for r in regress.nested_r2(fit, items).collect()}
    assert r2["M0"] == 0 and r2["M1"] == pytest.approx(r2["M2"]) and r2["M2"] <= r2["M3"] + 1e-12
    boot = regress.bootstrap_shift(fit, items, replicates=300)
    shift = regress.group_shift(regress.residualize(fit, items)).first()
    ci = regress.interval(boot).first()
    assert ci.ci_low < shift.delta < ci.ci_high and abs(boot.agg(F.avg("delta")).first()[0] - shift.delta) < 0.1
    other = regress.bootstrap_shift(fit.repartition(5), items, replicates=300)
    assert {r.replicate: round(r.delta, 9) for r in other.collect()} == {r.replicate: round(r.delta, 9) for r in boot.collect()}


def test_logistic_score_equations_and_separation(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(40), rng.integers(0, 2, (40, 3))])
    n = rng.integers(1, 30, 40).astype(float)
    right = rng.binomial(n.astype(int), 1 / (1 + np.exp(-x @ [0.2, -1, 0.5, 0.3]))).astype(float)
    codes = [np.where(x[:, k] > 0, k, -1) for k in (1, 2, 3)]
    beta, converged = Lanes(codes, [(1, 2), (2, 3), (3, 4)], 4).logistic(n[None], right[None])
    assert converged[0] and np.abs(x.T @ (right - n / (1 + np.exp(-x @ beta[0])))).max() < 1e-3
    assert not Lanes([np.array([-1, 1])], [(1, 2)], 2).logistic(np.array([[5.0, 5]]), np.array([[5.0, 0]]))[1][0]
    rows = [("few", 1, "c", True, "I-II", 1)] + [("one", i, "c", True, "I-II", 1) for i in range(30)] + [("ok", i, f"c{i % 3}", i % 2 == 0, ["I-II", "V-VI"][i % 4 // 2], int(rng.random() < 0.6)) for i in range(200)]
    answers = spark.createDataFrame(rows, "model_id string, item_id long, category string, truth boolean, grp string, y int")
    got = regress.logistic_by_model(answers, replicates=60).toPandas().set_index("model_id")
    assert got.loc["few", "skipped"] == "few_answers" and got.loc["one", "skipped"] == "degenerate_accuracy"
    ok = got.loc["ok"]
    assert set(ok["term"]) == {"(intercept)", "truth_True", "category_c1", "category_c2", "grp_V-VI"} and (ok["ci_low"] < ok["ci_high"]).all()
    pooled = regress.pooled_logistic(answers.where("model_id = 'ok'"), replicates=120).first()
    assert pooled.ci_low < pooled.beta < pooled.ci_high and pooled.n_obs == 200


def test_hash_draws_are_uniform():
    u = kernels.hash_draws(7, np.arange(300), np.arange(400))
    assert abs(u.mean() - 0.5) < 0.01 and u.min() >= 0 and u.max() < 1
    w = kernels.poisson_weights(7, np.arange(300), np.arange(400))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


# -- plans ----------------------------------------------------------------------------------------------------


def test_average_ranks_and_running_total(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 30, 300).astype(float)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").repartition(6)
    got = {r.i: r.k for r in stats.average_ranks(frame, "v", "k").collect()}
    want = pd.Series(values).rank()
    assert all(got[i] == want[i] for i in range(300))


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_only_ranks_are_broadcast_and_never_the_ranked_rows(spark, monkeypatch):
    frame = spark.range(0, 20, 1, 1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5 * F.col("id") % 7).cast("double").alias("y"))
    want = frame.toPandas().rank().corr().loc["x", "y"]
    few = stats.spearman(frame, "x", "y")
    assert "BuildRight" in _plan(few) and "BuildLeft" not in _plan(few)
    monkeypatch.setattr(stats, "_BROADCAST_RANKS", 2)
    many = stats.spearman(frame, "x", "y")
    assert _plan(many).count("SortMergeJoin") == 2
    assert [f.first().rho == pytest.approx(want) for f in (few, many)] == [True, True]


def test_a_large_table_of_items_is_not_broadcast(spark, monkeypatch):
    want = queries.QUERIES["jn6_compare_fits"](spark, SMALLEST).collect()
    monkeypatch.setattr(fixtures, "_BROADCAST_ITEMS", 10)
    views = queries.Views(spark, SMALLEST)
    assert "BroadcastHashJoin" not in _plan(responses.attach_items(views.log, views.items))
    assert queries.QUERIES["jn6_compare_fits"](spark, SMALLEST).collect() == want


def test_gapless_rank(spark):
    frame = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('g', id % 7)) AS g")
    got = ranks.gapless_rank(frame, ["g"], F.pmod(F.xxhash64("id"), F.lit(9)), [F.col("id")], "k").toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["k"]) == list(range(len(part)))


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long"), storage.Scratch(spark, "test"), "c").collect()}
    assert got == {x: find(x) for x in parent}


def test_zero_shot_text_is_parsed_back(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.9])], "item_id long, embedding array<float>")
    found = vectors.zero_shot(emb, {"benign": [1, 0], "malignant": [0, 1]}, scale=10)
    parsed = responses.parse_answers(found.withColumnRenamed("label", "given").withColumnRenamed("confidence", "sure"))
    rows = {r.item_id: r for r in parsed.collect()}
    assert all(r.label == r.given and r.confidence == r.sure for r in rows.values())
    assert rows[1].label == "benign" and rows[2].label == "malignant" and rows[1].sure == "high" and rows[3].p < rows[1].p


def test_probe_writes_answers(spark):
    rng = np.random.default_rng(9)
    rows = [(i, bool(i % 2), [float(x) for x in rng.normal(1.5 if i % 2 else -1.5, 1, 3)]) for i in range(80)]
    items = spark.createDataFrame([r[:2] for r in rows], "item_id long, truth boolean")
    emb = spark.createDataFrame([(r[0], r[2]) for r in rows], "item_id long, embedding array<float>")
    got = regress.crossfit_probe(emb, items, 4).toPandas()
    assert len(got) == 80 and (got["predicted"] == got["truth"]).mean() > 0.9 and set(got.groupby("fold").size()) == {20}


def test_refusal_rate_counts_all_items(spark):
    items = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(6)], "item_id long, grp string")
    cells = spark.createDataFrame([("m", 0, None, True), ("m", 5, 1, False)], "model_id string, item_id long, y int, refused boolean")
    registry = spark.createDataFrame([("m",), ("n",)], "id string")
    got = {(r.grp, r.model_id): (r.n_refused, r.n_items) for r in reports.refusal_rate(cells, items, registry).collect()}
    assert got == {("a", "m"): (1, 4), ("a", "n"): (0, 4), ("b", "m"): (0, 2), ("b", "n"): (0, 2), ("a", None): (1, 8), ("b", None): (0, 4)}


# -- registered queries ------------------------------------------------------------------------------

SMALLEST = "/root/testdata/sf0.001"


class _Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "function"),
    [
        ("ir1_fit_rasch", irt, "fit_rasch"),
        ("ir2_fit_amortized", irt, "fit_amortized"),
        ("ir3_score_difficulty", irt, "fit_amortized"),
        ("ir8_calibrate", irt, "calibrate"),
        ("ir9_configural_invariance", irt, "configural_invariance"),
        ("ir9_configural_invariance_amortized", irt, "fit_amortized_together"),
        ("ir10_sweep", irt, "fit_amortized_together"),
        ("rg4_bootstrap_shift", regress, "bootstrap_shift"),
        ("rg5_decide", regress, "bootstrap_shift"),
        ("rg6_fit_lltm_intervals", regress, "fit_lltm"),
        ("rg8_logistic_by_model", regress, "logistic_by_model"),
        ("rg9_pooled_logistic", regress, "pooled_logistic"),
        ("rg10_matched_gap_bootstrap", regress, "matched_gap_bootstrap"),
        ("rg11_refusal_logit", regress, "refusal_logit"),
        ("st6_permutation_test", stats, "permutation_test"),
    ],
)
def test_registered_queries_keep_the_operators_defaults(spark, monkeypatch, name, module, function):
    given = {}

    def spy(*args, **options):
        given.update(options)
        raise _Called

    monkeypatch.setattr(module, function, spy)
    with pytest.raises(_Called):
        queries.QUERIES[name](spark, SMALLEST)
    assert not {"max_iter", "tol", "inner", "hidden", "replicates", "n_perm", "fit"} & set(given)


def test_log_of_all_respondents_is_appended(spark):
    want = {r.model_id: r.n for r in fixtures.log(spark, SMALLEST).groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(want) == 9 and {r.model_id: r.n for r in queries.QUERIES["snk1_append_log"](spark, SMALLEST).collect()} == want


@pytest.mark.parametrize("name", list(queries.REDUCED))
def test_reduced_form_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    build, sql = queries.REDUCED[name]
    with duckdb.connect() as db:
        for path in sorted(Path(SMALLEST).glob("*.parquet")):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path if path.is_file() else path / '*.parquet'}')")
        want = db.execute(sql)
        names, rows = [c[0] for c in want.description], want.fetchall()
    got = build(spark, SMALLEST)
    key = lambda r: [str(x) for x in r if not isinstance(x, float)] + [x for x in r if isinstance(x, float)]
    mine, theirs = sorted((list(r) for r in got.select(*names).collect()), key=key), sorted(map(list, rows), key=key)
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)
