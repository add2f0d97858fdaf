"""Operators that cut their work into blocks, against plain Python on small tables."""

import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.functions.kernels import hash_draws
from plumbline.functions.text import unit_hash
from plumbline.operators import irt, regress, reports, responses, stats
from plumbline.plans import components, storage
from plumbline.sources import tables


def _kappa(rows):
    by_model = {}
    for m, i, label, _ in rows:
        by_model.setdefault(m, {})[i] = label == "malignant"
    out = {}
    for a, b in itertools.combinations(sorted(by_model), 2):
        both = sorted(set(by_model[a]) & set(by_model[b]))
        if both:
            x, y = (np.array([by_model[m][i] for i in both]) for m in (a, b))
            e = x.mean() * y.mean() + (1 - x.mean()) * (1 - y.mean())
            out[a, b] = (len(both), None if e == 1 else ((x == y).mean() - e) / (1 - e))
    return out


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_kappa_by_blocks_of_respondents(spark, block):
    rng = np.random.default_rng(1)
    rows = [(f"m{m}", f"{i}.png", str(rng.choice(["benign", "malignant"])), 1) for m in range(7) for i in range(40) if rng.random() < 0.6]
    rows += [("m9", "0.png", "benign", None)]
    frame = spark.createDataFrame(rows, "model_id string, item_id string, label string, y int").repartition(5)
    got = {(r.model_a, r.model_b): (r.n, r.kappa) for r in reports.kappa_matrix(frame, block).collect()}
    want = _kappa([r for r in rows if r[3] is not None])
    assert set(got) == set(want)
    for pair, (n, kappa) in want.items():
        assert got[pair][0] == n and got[pair][1] == (None if kappa is None else pytest.approx(kappa))


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.777, 1.0])
def test_holdout_takes_the_least_hashes(spark, fraction):
    items = spark.range(501).selectExpr("concat(id, '.png') AS item_id", "id")
    got = responses.holdout_split(items, fraction, 5)
    assert got.columns == ["item_id", "id", "holdout"]
    hashed = sorted((r.h, r.item_id) for r in items.select("item_id", unit_hash(*(responses.F.lit("5"), responses.F.col("item_id"))).alias("h")).collect())
    assert {r.item_id for r in got.collect() if r.holdout} == {i for _, i in hashed[: int(fraction * 501)]}
    assert responses.holdout_split(items.limit(0), 0.5).count() == 0


def test_permutations_match_plain_python(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"m{m}", i, float(rng.normal() + (m > 3) * (i % 3)), m > 3) for i in range(12) for m in range(8) if rng.random() < 0.8 or i < 2]
    rows += [("m0", 50, 1.0, False), ("m1", 50, 2.0, False)]
    frame = spark.createDataFrame(rows, "model_id string, item_id int, resid double, focal boolean")
    monkeypatch.setattr(stats, "_DRAWS_AT_ONCE", 40)
    got = {r.item_id: r.permutation_p for r in stats.permutation_test(frame, n_perm=300, seed=9).collect()}
    for i in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == i)
        resid, mask = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        k, n = int(mask.sum()), len(own)
        if k in (0, n):
            assert got[i] is None
            continue
        seen, count = abs(resid[mask].mean() - resid[~mask].mean()), 0
        for draw in hash_draws(9, np.arange(300), np.arange(n)):
            focal = np.isin(np.arange(n), np.argsort(draw, kind="stable")[:k])
            count += abs(resid[focal].mean() - resid[~focal].mean()) >= seen - 1e-12
        assert got[i] == pytest.approx((count + 1) / 301)


def test_rasch_of_nothing(spark):
    item_fit, model_fit = irt.fit_rasch(spark.createDataFrame([], "model_id string, item_id string, y int"))
    assert item_fit.count() == 0 and model_fit.count() == 0


def test_abilities_settle_in_eight_rounds(spark, monkeypatch):
    """The arrowhead step reaches the optimum of the alternating rounds, and in far fewer."""
    rng = np.random.default_rng(11)
    ability, hard = rng.normal(0, 1, 12), rng.normal(0, 1, 300)
    rows = [(f"m{j:02}", i, int(rng.random() < 1 / (1 + np.exp(hard[i] - ability[j])))) for j in range(12) for i in range(300) if rng.random() < 0.7]
    cells = responses.prune_saturated(spark.createDataFrame(rows, "model_id string, item_id long, y int").repartition(5))
    rounds, step = [], irt._ability_step
    monkeypatch.setattr(irt, "_ability_step", lambda *a: rounds.append(step(*a)) or rounds[-1])
    items, models = irt.fit_rasch(cells)
    assert len(rounds) <= 8 and np.abs(rounds[-1]).max() < 1e-8
    scored = irt.cell_probabilities(cells, models, items)
    for key in ("model_id", "item_id"):
        assert scored.groupBy(key).agg(F.abs(F.sum(F.col("y") - F.col("p"))).alias("s")).agg(F.max("s")).first()[0] < 1e-6
    monkeypatch.setattr(irt, "_CURVED_MODELS", 0)
    slow = {r.model_id: r.theta for r in irt.fit_rasch(cells)[1].collect()}
    assert all(abs(slow[r.model_id] - r.theta) < 1e-6 for r in models.collect()) and len(rounds) > 16


def test_fits_that_share_their_scans_are_single_fits(spark):
    """Seeds and penalties, item subsets and what they cost: three points take fewer jobs than one and a half fits."""
    rng = np.random.default_rng(12)
    emb = rng.normal(size=(120, 6))
    hard = emb @ rng.normal(size=6) * 0.5
    rows = [(f"m{j}", i, int(rng.random() < 1 / (1 + np.exp(hard[i] - j / 3)))) for j in range(5) for i in range(120) if not (j == 4 and i % 2)]
    cells = spark.createDataFrame(rows, "model_id string, item_id long, y int").repartition(3)
    vectors = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(emb)], "item_id long, embedding array<double>")
    points = [{"seed": 1}, {"seed": 2, "difficulty_l2": 0.1}, {"seed": 1, "ability_l2": 0.5}]
    together = irt.fit_amortized_together(cells, vectors, points, hidden=5, max_iter=15)
    for point, fit in zip(points, together, strict=True):
        alone = irt.fit_amortized(cells, vectors, hidden=5, max_iter=15, **point)
        assert fit.models == alone.models and np.allclose(fit.theta, alone.theta, atol=1e-8) and np.allclose(fit.history, alone.history)
        assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(fit.network.weights, alone.network.weights, strict=True))
    odd = spark.range(120).selectExpr("id AS item_id", "IF(id % 2 = 0, 1, 2) AS lanes")
    halves = irt.fit_amortized_together(cells, vectors, [{}, {}], hidden=5, max_iter=15, lanes=odd)
    assert halves[0].models == ["m0", "m1", "m2", "m3", "m4"] and halves[1].models == ["m0", "m1", "m2", "m3"]
    alone = irt.fit_amortized(cells.where("item_id % 2 = 1"), vectors, hidden=5, max_iter=15)
    assert np.allclose(halves[1].theta, alone.theta, atol=1e-8)


LOGGED = "model_id STRING, item_id STRING, raw_text STRING, error STRING, ord LONG"


def _log_rows(rng, n):
    texts = ["Answer: benign", "Answer: malignant", "I cannot say", "nothing", "Answer: benign\nConfidence: low"]
    return [(f"m{rng.integers(4)}", str(rng.integers(12)), texts[rng.integers(5)], None if rng.random() < 0.8 else "timeout", i) for i in range(n)]


def test_a_batch_that_is_written_again_replaces_its_own_rows(spark, tmp_path):
    rows = _log_rows(np.random.default_rng(13), 90)
    frame, path = spark.createDataFrame(rows, LOGGED), f"file://{tmp_path}/log"
    tables.append_log(frame.where("ord < 30"), path, "a")
    failing = frame.where("ord BETWEEN 30 AND 59").repartition(3).withColumn("raw_text", F.when(F.col("ord") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("raw_text")))
    with pytest.raises(Exception, match="lost"):
        tables.append_log(failing, path, "b")
    assert tables.read_log(spark, path, schema=LOGGED).count() == 30
    for batch, low in (("b", 30), ("c", 60), ("b", 30)):
        tables.append_log(frame.where(F.col("ord").between(low, low + 29)), path, batch)
    for mode in ("lenient", "strict"):
        got = tables.read_log(spark, path, mode, LOGGED)
        assert got.columns == frame.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_a_state_follows_the_log(spark, tmp_path):
    """Versions over batches of any size, one that failed midway among them, give what the whole log gives; only new batches are read."""
    rng = np.random.default_rng(14)
    rows = _log_rows(rng, 200) + [("stranger", "3", "Answer: benign", None, 900), ("m0", "unknown", "Answer: benign", None, 901)]
    items = spark.createDataFrame([(str(i), i % 2 == 0) for i in range(12)], "item_id string, truth boolean")
    registry = spark.createDataFrame([(f"m{i}",) for i in range(5)], "id string")
    frame, path = spark.createDataFrame(rows, LOGGED).repartition(4), f"file://{tmp_path}/log"
    state = tables.LogState(spark, f"file://{tmp_path}/state", items, registry, LOGGED)
    cuts = [0, 50, 51, 140, 1000]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        tables.append_log(frame.where((F.col("ord") >= lo) & (F.col("ord") < hi)), path, f"b{k}")
        if k == 2:  # an update that was lost after its pairs were written
            state.read().write.parquet(f"file://{tmp_path}/state/v2/pairs")
        assert state.update(path) == [f"batch=b{k}"] and state.update(path) == []
        log = frame.where(F.col("ord") < hi)
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
        assert same(responses.cells_of_state(state.read()), responses.response_cells(log, items, registry))
        assert same(responses.summary_of_state(state.read()), responses.log_summary(log))
        assert same(responses.coverage(responses.cells_of_state(state.read()), 9), responses.coverage(responses.response_cells(log, items, registry), 9))


def test_probes_of_all_folds_are_separate_fits(spark):
    """Against the library's own logistic regression, trained fold by fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 5)) * [1, 5, 0.1, 1, 0] + 3
    rows = [(i, bool(x[i] @ [1, 0.2, -4, 0, 0] - 3.6 + rng.normal() > 0), x[i].tolist()) for i in range(300)]
    items = spark.createDataFrame([(i, t) for i, t, _ in rows], "item_id long, truth boolean")
    vectors = spark.createDataFrame([(i, e) for i, _, e in rows], "item_id long, embedding array<double>").repartition(3)
    got = {r.item_id: r for r in regress.crossfit_probe(vectors, items, k=3).collect()}
    frame = regress.folds(items.join(vectors, "item_id").select("item_id", "truth", "embedding"), 3, 0)
    frame = frame.select("item_id", "fold", F.col("truth").cast("double").alias("label"), array_to_vector("embedding").alias("raw"))
    for fold in range(3):
        train, test = frame.where(F.col("fold") != fold), frame.where(F.col("fold") == fold)
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
        probe = LogisticRegression(regParam=1 / train.count(), standardization=False, maxIter=200, tol=1e-10).fit(scaler.transform(train))
        for r in probe.transform(scaler.transform(test)).collect():
            assert got[r.item_id].fold == fold and got[r.item_id].predicted == (r.prediction == 1)
    assert sum(r.predicted == r.truth for r in got.values()) > 220


def test_dictionary_of_masks_gives_the_same_draws():
    drawn = {}
    for focal, times in stats._masks(9, 4, 3000, 5, 7):
        for m, t in zip(focal, times, strict=True):
            drawn[m.tobytes()] = drawn.get(m.tobytes(), 0) + int(t)
    plain = {}
    for focal in stats._drawn_masks(9, 4, 3000, 5, 100):
        for m in focal:
            plain[m.tobytes()] = plain.get(m.tobytes(), 0) + 1
    assert drawn == plain and len(drawn) == 126 and sum(len(f) for f, _ in stats._masks(30, 9, 500, 5, 7)) == 500


def test_balanced_subsets_are_the_least_hashes(spark):
    rows = [(i, "a" if i % 3 else None, i % 5 == 0) for i in range(3000)]
    items = spark.createDataFrame(rows, "item_id long, grp string, truth boolean").repartition(4)
    got = {r.item_id for r in responses.stratified_subset(items, ["grp", "truth"], 2100, 3).collect()}
    hashes = {r.item_id: r.h for r in items.select("item_id", unit_hash(F.lit("3"), F.col("item_id").cast("string")).alias("h")).collect()}
    want = set()
    for stratum in {r[1:] for r in rows}:
        want |= {i for _, i in sorted((hashes[r[0]], r[0]) for r in rows if r[1:] == stratum)[:525]}
    assert got == want


def test_a_hub_is_no_task_of_its_own(spark):
    """A star of a million nodes: the links that the join of a round gives lie as evenly as those that it read."""
    star = spark.range(1, 1_000_001, numPartitions=16).selectExpr("id AS u", "CAST(0 AS BIGINT) AS v")
    both = star.union(star.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, value in zip(before, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, value)
        joined = components.with_least(both, least, 2_000_000)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 2_000_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_components_of_hubs_and_paths_where_hubs_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(16)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))] + [(399, 1000)]
    want = {}
    for a, b in links:
        merged = want.get(a, {a}) | want.get(b, {b})
        want.update(dict.fromkeys(merged, merged))
    monkeypatch.setattr(components, "_HUB_LINKS", 0)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(3), storage.Scratch(spark, "hubs"), "c").collect()}
    assert got == {n: min(c) for n, c in want.items() if len(c) > 1}


def test_release_leaves_nothing_in_the_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(storage, "_made", set())
    scratch = storage.Scratch(spark, "released")
    assert scratch.table(spark.range(5), "five").count() == 5
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(folder) and storage.release(spark) == 1 and not files.exists(folder) and storage.release(spark) == 0
