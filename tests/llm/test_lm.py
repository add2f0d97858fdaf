"""LM scoring: gradients, held-out gain over the unigram model, the two levels against plain sums, and counts against plain Python."""

import math
import types
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import lm_score, textkit


def _vocabulary(words, counts=None):
    hashes = textkit.words_of([" ".join(words)])[0]
    return lm_score.Vocabulary(hashes, np.array(counts or [5.0] * len(words)), np.arange(len(words)), 4)


def _chain(rng, n, length=40):
    words = [f"k{i}" for i in range(60)]
    return [" ".join(words[(int(s) + k * 7) % 60] for k in range(length)) for s in rng.integers(0, 60, n)]


def test_gradients():
    rng = np.random.default_rng(0)
    v = _vocabulary([f"w{i}" for i in range(37)], [int(x) for x in rng.integers(1, 50, 37)])
    net = lm_score.WindowNetwork(v, 30, width=2, embed=5, hidden=6, dtype=np.float64)
    ids = np.append(rng.integers(0, 37, 90), [v.known + 3, v.known + 9, v.edge - 1])
    laid, place = lm_score.lay_out(ids, np.array([0, 40, 40, 93]), 2, v.edge)
    _, gradients = net.loss_and_gradients(laid, place)
    for name, w in net.weights.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in w.shape) if name != "embed" else (int(rng.choice(ids)), int(rng.integers(5)))
            if name == "word_bias" and w[at] < -100:
                continue
            w[at] += 1e-5
            up = net.loss_and_gradients(laid, place)[0]
            w[at] -= 2e-5
            down = net.loss_and_gradients(laid, place)[0]
            w[at] += 1e-5
            assert gradients[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8), name


def test_both_levels_sum_to_one_and_match_a_plain_forward_pass():
    rng = np.random.default_rng(1)
    v = _vocabulary([f"w{i}" for i in range(37)])
    net = lm_score.WindowNetwork(v, 9, width=2, embed=5, hidden=6, dtype=np.float64)
    texts = [list(map(int, rng.integers(0, 37, n))) for n in (1, 0, 7, 3)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.log_probabilities(*lm_score.lay_out(np.concatenate(texts).astype(int), first, 2, v.edge))
    w, at = net.weights, 0
    for text in texts:
        for i, own in enumerate(text):
            around = [text[i + k] if 0 <= i + k < len(text) else v.edge for k in (-2, -1, 1, 2)]
            h = np.tanh(sum(w["embed"][a] * m for a, m in zip(around, w["mix"], strict=True)) @ w["hidden"] + w["hidden_bias"])
            by_class = np.exp(h @ w["class"] + w["class_bias"])
            by_class /= by_class.sum()
            total = by_class[-1]
            for c in range(v.classes):
                p = np.exp(w["word"][c] @ h + w["word_bias"][c])
                p /= p.sum()
                total += by_class[c] * p.sum()
                if own // v.size == c:
                    assert got[at] == pytest.approx(math.log(by_class[c] * p[own % v.size]))
            assert total == pytest.approx(1)
            at += 1


def test_held_out_gain_over_the_unigram_model(spark):
    rng = np.random.default_rng(2)
    texts, fresh = _chain(rng, 300), _chain(rng, 40)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trained, unigram = (lm_score.fit_lm(frame, epochs=e).network for e in (12, 0))
    words, first = textkit.words_of(fresh)
    mean = [n.log_probabilities(*lm_score.lay_out(n.vocabulary.ids_of(words), first, n.width, n.vocabulary.edge)).mean() for n in (trained, unigram)]
    assert mean[0] > mean[1] + 1


def test_the_corpus_order_is_preferred(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(_chain(rng, 300)))
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:20]]
    frame = spark.createDataFrame([(*r, 1, 2.0, "r") for r in [*rows, *shuffled, (5000, None), (5001, ""), (None, "k1 k2 k3")]], "doc_id long, text string, n_tokens int, log_likelihood double, row string")
    got = {r.doc_id: r for r in lm_score.score_documents(frame, epochs=12).collect()}
    assert got[5000].n_tokens == 0 and got[5000].log_likelihood == 0 and got[5001].mean_log_likelihood is None and got[None].n_tokens == 3
    for i in range(20):
        assert got[i].log_likelihood > got[1000 + i].log_likelihood + 10


def test_every_words_probability_by_plain_counts(spark):
    """Scores are the network's sums and, for words outside its vocabulary, shares that plain counts of the words give; in random
    contexts the probabilities of all words of the corpus add up to 1."""
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(10)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.7 else f"R{int(rng.integers(60))}" for _ in range(30))
    rows = [(i, text()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "r1 " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    options = {"vocabulary": 10, "min_count": 50, "few": 25}
    got = {r.doc_id: r.log_likelihood for r in lm_score.score_documents(frame, **options, epochs=1).collect()}
    model = lm_score.fit_lm(frame, **options, epochs=1)
    v = model.network.vocabulary
    tokens = {i: (t or "").lower().split() for i, t in rows}
    count = Counter(w for t in tokens.values() for w in t)
    names = list(count)
    hashes = textkit.words_of([" ".join(names)])[0]
    known = {w for w, h in zip(names, hashes, strict=True) if h in v.words}
    assert known and known < set(common) | {"r1"} and len(model.common)
    group = {w: int(h) % 256 for w, h in zip(names, hashes, strict=True)}
    sums = Counter()
    for w in set(names) - known:
        sums[group[w]] += count[w] - 0.95
    logs = {w: 0.0 if w in known else math.log((count[w] - 0.95) / sums[group[w]]) for w in names}
    for i, t in tokens.items():
        words, first = textkit.words_of([" ".join(t)])
        want = model.network.log_probabilities(*lm_score.lay_out(v.ids_of(words), first, 3, v.edge)).sum() + sum(logs[w] for w in t)
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)
    for _ in range(5):
        around = list(rng.choice(names, 6))
        total = 0.0
        for w in names:
            words, first = textkit.words_of([" ".join([*around[:3], w, *around[3:]])])
            total += math.exp(model.network.log_probabilities(*lm_score.lay_out(v.ids_of(words), first, 3, v.edge))[3] + logs[w])
        assert total == pytest.approx(1, abs=1e-5)


def test_a_text_that_occurs_twice_scores_higher(spark):
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"v{int(k)}" for k in rng.integers(0, 4000, 60))
    once, twice = [text() for _ in range(60)], [text() for _ in range(10)]
    rows = list(enumerate([*once, *twice, *twice]))
    got = {r.doc_id: r.mean_log_likelihood for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in range(60, 80)) > max(got[i] for i in range(60))


def test_stretches_cover_every_word_once():
    texts = ["a b c", None, " ".join(f"w{i}" for i in range(150)), "", "x " * 64]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    found = [np.array(s) for b in lm_score._stretches(iter([batch]), 3, 1 << 53) for s in b.column("words").to_pylist()]
    inner = np.concatenate([s[3:-3] for s in found]).view(np.uint64)
    assert sorted(inner.tolist()) == sorted(textkit.words_of(texts)[0].tolist())
    assert [len(s) - 6 for s in found] == [3, 64, 64, 22, 64]
    words = textkit.words_of([texts[2]])[0].view(np.int64)
    assert found[2].tolist() == words[61:131].tolist() and found[0][:3].tolist() == [0, 0, 0]


def test_least_count(spark):
    frame = spark.range(1, 2000).selectExpr("id AS word", "CAST(1 + 100000 / id AS BIGINT) AS n")
    for at_most in (0, 1, 7, 100, 1500, 5000):
        least = lm_score.least_count(frame, at_most)
        assert frame.where(f"n >= {least}").count() <= at_most
        assert at_most < 7 or frame.where(f"n >= {least}").count() > 0.8 * min(at_most, 1999)


@pytest.mark.parametrize("alone", [1 << 20, 1000])
def test_every_token_trains_the_network_once_a_pass(spark, monkeypatch, tmp_path, alone):
    """Not a sample: whether one task takes all or several share them, in rounds, each token of each text is predicted once, copies too."""
    seen, batched = str(tmp_path), lm_score._batched

    def noted(stretches, vocabulary, width, size, epochs):
        for laid, place in batched(stretches, vocabulary, width, size, epochs):
            np.save(f"{seen}/{uuid.uuid4().hex}.npy", laid[place])
            yield laid, place

    # tasks are sent the function that this module holds, with its closure
    trained = lm_score._trained
    noting = types.FunctionType(trained.__code__, {**trained.__globals__, "_batched": noted}, trained.__name__, trained.__defaults__, trained.__closure__)
    noting.__module__ = "__main__"
    monkeypatch.setattr(lm_score, "_trained", noting)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, int(n)) if k < 10**9) for n in rng.integers(0, 200, 120)]
    texts += [texts[0]] * 30 + [None, "", "lone"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    v = lm_score.fit_lm(frame, epochs=2, alone=alone).network.vocabulary
    want = np.bincount(v.ids_of(textkit.words_of(texts)[0]), minlength=v.edge)
    got = np.bincount(np.concatenate([np.load(f) for f in tmp_path.glob("*.npy")]), minlength=v.edge)
    assert got.tolist() == (2 * want).tolist() and len(list(tmp_path.glob("*.npy"))) > 1


def test_profiles_are_counted_over_all_texts(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 30, 80)] + [None, "a", "a b"]
    names = list("abcdef")
    words = np.concatenate([textkit.words_of([w])[0] for w in names])
    got = lm_score.profiles_of(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), words, neighbours=3)
    want = np.zeros((6, 8))
    for t in texts:
        own = (t or "").split()
        for i, w in enumerate(own):
            for side, k in ((0, i - 1), (4, i + 1)):
                near = names.index(own[k]) if 0 <= k < len(own) and own[k] in names else 3
                if w in names:
                    want[names.index(w), side + min(near, 3)] += 1
    assert got == pytest.approx(np.sqrt(want / want.sum(1, keepdims=True)))


def test_training_by_parts_gains_as_well(spark):
    """Tasks that start from common weights and are averaged, in rounds, beat the unigram model on fresh texts."""
    rng = np.random.default_rng(2)
    texts, fresh = _chain(rng, 1200), _chain(rng, 40)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trained, unigram = (lm_score.fit_lm(frame, epochs=e, alone=6000).network for e in (6, 0))
    words, first = textkit.words_of(fresh)
    mean = [n.log_probabilities(*lm_score.lay_out(n.vocabulary.ids_of(words), first, n.width, n.vocabulary.edge)).mean() for n in (trained, unigram)]
    assert mean[0] > mean[1] + 0.5


def _large_tree(dtype=np.float64):
    words = [f"w{i}" for i in range(24 * 60)]
    hashes = textkit.words_of([" ".join(words)])[0]
    v = lm_score.Vocabulary(hashes, np.random.default_rng(3).integers(1, 50, len(words)).astype(float), np.arange(len(words)), 24)
    return v, lm_score.WindowNetwork(v, 30, width=2, embed=5, hidden=6, dtype=dtype)


def test_many_words_have_more_levels_that_match_a_plain_forward_pass():
    """Sets of classes, classes, parts and words: probabilities of all words add up to 1, and each is the product of its branches' shares."""
    v, net = _large_tree()
    assert v.tree == [3, 8, 2, 32] and (v.classes, v.size) == (24, 64)
    w, around = net.weights, [5, v.known + 7, 600, v.edge]
    h = np.tanh(sum(w["embed"][a] * m for a, m in zip(around, w["mix"], strict=True)) @ w["hidden"] + w["hidden_bias"])

    def shares(inner, bias):
        p = np.exp(inner @ h + bias)
        return p / p.sum()

    top = shares(w["class"].T, w["class_bias"])
    total = top[-1]
    for word, own in zip(v.words, v.ids, strict=True):
        s, c, part = own // 512, own // 64, own // 32
        want = top[s] * shares(w["branch1"][s], w["branch1_bias"][s])[c % 8] * shares(w["branch2"][c], w["branch2_bias"][c])[part % 2]
        want *= shares(w["word"][part], w["word_bias"][part])[own % 32]
        laid, place = lm_score.lay_out(np.array([*around[:2], own, *around[2:]]), np.array([0, 5]), 2, v.edge)
        assert net.log_probabilities(laid, place)[2] == pytest.approx(math.log(want))
        total += want
    assert total == pytest.approx(1) and len(v.words) == 1440


def test_gradients_of_more_levels():
    v, net = _large_tree()
    rng = np.random.default_rng(0)
    ids = np.append(rng.choice(v.ids, 2500), [v.known + 3, v.known + 9, v.edge - 1])
    laid, place = lm_score.lay_out(rng.permutation(ids), np.array([0, 40, 40, 1900, len(ids)]), 2, v.edge)
    _, gradients = net.loss_and_gradients(laid, place)
    for name, w in net.weights.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in w.shape) if name != "embed" else (int(rng.choice(ids)), int(rng.integers(5)))
            if w[at] < -100:
                continue
            w[at] += 1e-4
            up = net.loss_and_gradients(laid, place)[0]
            w[at] -= 2e-4
            down = net.loss_and_gradients(laid, place)[0]
            w[at] += 1e-4
            assert gradients[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-8), name


def test_a_token_meets_few_outputs_and_tasks_fill_their_batches():
    v = lm_score.Vocabulary(np.arange(8176, dtype=np.uint64), np.ones(8176), np.arange(8176), 64)
    assert v.known == 8192 == np.prod(v.tree) and sum(v.tree) + 1 == 53
    # 34 million tokens in 32 partitions on 6 cores: 8 tasks, not 32
    assert lm_score.task_count(34_000_000, 32, 6, 1 << 20) == 8 and lm_score.task_count(7_000_000, 32, 6, 1 << 20) == 6
    assert lm_score.task_count(10**10, 1000, 6, 1 << 20) == 1000 and lm_score.task_count(10, 32, 6, 1 << 20) == 1


@pytest.mark.parametrize("n", [0, 1, 8, 3000])
def test_ids_of_words_whose_hashes_begin_alike(n):
    rng = np.random.default_rng(n)
    words = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    if n > 8:
        words = np.unique(np.concatenate([words[:-300], np.array([0, (1 << 64) - 1], np.uint64), np.arange(298, dtype=np.uint64) + np.uint64(7 << 48)]))
    v = lm_score.Vocabulary(words, np.ones(len(words)), np.arange(len(words)), 64)
    asked = np.concatenate([words, words + np.uint64(1), rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    ids = dict(zip(v.words.tolist(), v.ids.tolist(), strict=True))
    assert v.ids_of(asked).tolist() == [ids.get(int(a), v.known + int(a) % 4096) for a in asked]
