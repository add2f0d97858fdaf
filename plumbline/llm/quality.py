"""Quality classifier from weak labels.

1. Heuristic labellers vote on every document: low, fine, or no opinion. They overlap and are of unknown accuracy.
2. Expectation-maximisation over the counts of vote patterns, which all documents go into, estimates each labeller's accuracy
   and the share of low documents, and gives each pattern a posterior probability of `fine`. There are at most 3**labellers
   patterns, whatever the number of documents.
3. The posteriors label a bounded sample (the `max_train` distinct texts of the least seeded hashes over all documents), and a
   logistic scorer is trained on hashed features of word shapes and repetition. Unlike the labellers, it has an opinion on every text.
4. Every document is scored; below `threshold` it is rejected.

Empty and null texts get no votes and are rejected: there is nothing in them to keep. Texts may be of any length. Rows are judged one
by one, so repeated rows get equal scores; in the sample a text is one row, however many copies it has. Other columns are kept where that is
asked for, but for those with a result's name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches, concatenate, mix64, sliced, words_of
from plumbline.plans.storage import Scratch

DIMENSIONS = 1 << 16
_LABELLERS = ("symbols", "odd_words", "capitals", "repeated_words", "repeated_phrases", "one_word", "sentences", "word_length")
_LOW, _FINE, _NONE = 0, 1, 2

#: Bytes by kind: 0 white space, 1 lower-case, 2 upper-case, 3 digit, 4 sentence marks, 5 other marks, 6 non-ASCII.
_KIND = np.full(256, 5, np.uint8)
_KIND[list(b" \t\n\r\v\f")] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[list(b".,;:'\"?-()")] = 4
_KIND[128:] = 6
_SHAPE = np.frombuffer(b" aA0.#a", np.uint8)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


class Features:
    """Measures of each text of a batch, and its hashed features, computed for the whole batch at once."""

    def __init__(self, texts: list[str | None]):
        raw, starts = concatenate(texts)
        self.n = len(texts)
        self.words, self.first = words_of(texts)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        kind = _KIND[raw]
        sums = {k: self._sums(kind == k, starts) for k in (1, 2, 3, 5, 6)}
        letters = sums[1] + sums[2] + sums[6]
        chars = letters + sums[3] + sums[5]
        self.symbols = _share(sums[5], chars)
        self.capitals = _share(sums[2], letters)
        self.word_bytes = _share(chars, self.n_words)
        last = np.append(kind[1:] == 0, True)
        ends = ((raw == 46) | (raw == 63)) & last
        self.odd_words = _share(self._sums((kind == 5) & last, starts), self.n_words)
        self.sentence_ends = _share(self._sums(ends, starts), self.n_words)
        self.same = [np.zeros(len(self.words), bool)]
        for lag in range(1, 9):
            same = np.zeros(len(self.words), bool)
            same[lag:] = (self.words[lag:] == self.words[:-lag]) & (self.doc[lag:] == self.doc[:-lag])
            self.same.append(same)
        self.next_same = self._per_doc(self.same[1])
        self.fresh, self.top = self._repetition()
        self.shapes = self._shapes(raw, kind, starts)

    @staticmethod
    def _sums(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # every text has at least its closing blank, so no slice is empty
        return np.add.reduceat(mask.view(np.int8), starts[:-1], dtype=np.int64) if len(starts) > 1 else np.zeros(0, np.int64)

    def _per_doc(self, mask: np.ndarray) -> np.ndarray:
        return _share(np.bincount(self.doc, mask, self.n), self.n_words)

    def _repetition(self) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct three-word phrases, and of the most frequent word."""
        fresh, top = np.ones(self.n), np.zeros(self.n)
        w = self.words
        phrase = mix64(w[:-2] * np.uint64(3) + mix64(w[1:-1]) * np.uint64(5) + mix64(w[2:] + np.uint64(7))) if len(w) > 2 else w[:0]
        for d, (a, z) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            if z - a >= 3:
                p = np.sort(phrase[a : z - 2])
                fresh[d] = (1 + np.count_nonzero(p[1:] != p[:-1])) / len(p)
            if z > a:
                s = np.sort(w[a:z])
                edge = np.flatnonzero(np.append(s[1:] != s[:-1], True))
                top[d] = np.diff(edge, prepend=-1).max() / (z - a)
        return fresh, top

    def _shapes(self, raw: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of each word's shape: runs of letters, capitals, digits and marks, with other marks as they are."""
        if not len(raw):
            return self.words
        shape = np.where(kind == 5, raw, _SHAPE[kind])
        keep = np.append(True, (shape[1:] != shape[:-1]) | (kind[1:] == 0))
        kept = np.concatenate([[0], np.cumsum(keep)])[starts]
        flat = shape[keep].tobytes().decode("latin-1")
        hashes, first = words_of([flat[a:z] for a, z in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)])
        return hashes if len(hashes) == len(self.words) else np.zeros(len(self.words), np.uint64)

    def votes(self) -> np.ndarray:
        """(documents, labellers) of low, fine or no opinion. Each labeller leaves short texts and middling values open."""
        n = self.n_words

        def vote(low: np.ndarray, fine: np.ndarray, least: int) -> np.ndarray:
            return np.where(n < least, _NONE, np.where(low, _LOW, np.where(fine, _FINE, _NONE)))

        return np.stack(
            [
                vote(self.symbols > 0.04, self.symbols < 0.005, 1),
                vote(self.odd_words > 0.15, self.odd_words < 0.02, 4),
                vote(self.capitals > 0.5, self.capitals < 0.2, 5),
                vote(self.next_same > 0.3, self.next_same < 0.08, 5),
                vote(self.fresh < 0.5, self.fresh > 0.85, 12),
                vote(self.top > 0.34, self.top < 0.2, 12),
                vote(self.sentence_ends < 0.004, (self.sentence_ends > 0.03) & (self.sentence_ends < 0.5), 25),
                vote((self.word_bytes < 2) | (self.word_bytes > 16), (self.word_bytes > 3) & (self.word_bytes < 10), 12),
            ],
            axis=1,
        ).astype(np.int64)

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value), by document: shares of word shapes and repetitions, and coarse steps of the measures."""
        one = 1.0 / np.maximum(self.n_words, 1)
        slot = lambda h: (h >> np.uint64(40)).astype(np.int64) % DIMENSIONS
        docs, features, values = [self.doc], [slot(mix64(self.shapes))], [one[self.doc]]
        for lag in range(1, 9):
            at = self.doc[self.same[lag]]
            docs.append(at)
            features.append(np.full(len(at), slot(mix64(np.array([lag], np.uint64)))[0]))
            values.append(one[at])
        every = np.arange(self.n)
        steps = [self.symbols, self.odd_words, self.capitals, self.next_same, 1 - self.fresh, self.top]
        for i, measure in enumerate(steps):
            step = np.minimum(np.floor(measure * 20), 19).astype(np.uint64)
            docs.append(every)
            features.append(slot(mix64(step + np.uint64(1000 * (i + 1)))))
            values.append(np.full(self.n, 0.5))
        short = np.minimum(self.n_words, 12).astype(np.uint64)
        docs.append(every)
        features.append(slot(mix64(short + np.uint64(9000))))
        values.append(np.full(self.n, 0.5))
        doc, feature, value = np.concatenate(docs), np.concatenate(features), np.concatenate(values)
        key = doc * DIMENSIONS + feature
        keys, place = np.unique(key, return_inverse=True)
        return keys // DIMENSIONS, keys % DIMENSIONS, np.bincount(place, value, len(keys))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for labellers that are independent given the class. Returns each pattern's posterior of `fine`, accuracies and prior.

    patterns: (patterns, labellers); counts: documents with each. accuracies[c, k, v]: probability that labeller k, if it
    votes, votes v on class c; having no opinion says nothing of the class. Starts from the votes against a document.
    """
    one_hot = np.eye(3)[patterns][:, :, :2]
    for_fine, for_low = (patterns == _FINE).sum(1), (patterns == _LOW).sum(1)
    # a labeller that sees something wrong weighs more than one that sees nothing wrong
    fine = np.where(for_low > 0, 0.5 ** (2 * for_low) * 0.8, np.where(for_fine > 0, 0.95, 0.8))
    prior, accuracy = 0.8, np.zeros((2, patterns.shape[1], 2))
    for _ in range(rounds):
        weight = np.stack([(1 - fine) * counts, fine * counts])
        accuracy = np.einsum("cp,pkv->ckv", weight, one_hot) + 0.02
        accuracy /= accuracy.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        score = np.einsum("pkv,ckv->cp", one_hot, np.log(accuracy)) + np.log([1 - prior, prior])[:, None]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - fine).max() < 1e-9:
            break
        fine = new
    return fine, accuracy, prior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by full-batch steps with per-feature rates. Returns weights and offset."""
    weights, offset = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return weights, offset
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.concatenate([f for f, _ in rows])
    value = np.concatenate([v for _, v in rows])
    squares, square = np.full(DIMENSIONS, 1e-12), 1e-12
    # both classes weigh the same
    weigh = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * weights[feature], len(rows)) + offset, -30, 30)))
        error = (p - target) * weigh
        gradient = np.bincount(feature, value * error[doc], DIMENSIONS) + l2 * weights
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
        square += error.sum() ** 2
        offset -= 0.5 * error.sum() / np.sqrt(square)
    return weights, offset


_POWERS = 3 ** np.arange(len(_LABELLERS))
_VOTED = "votes int, hash long, feature array<int>, value array<float>"


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The votes on each text, and the hashed features of those whose hash isn't null, of copies in a slice once."""
    for batch in sliced(batches, "t"):
        texts, hashes = batch.column("t").to_pylist(), batch.column("hash").to_pylist()
        votes = Features(texts).votes() @ _POWERS
        once = {h: i for i, h in reversed(list(enumerate(hashes))) if h is not None}
        chosen = sorted(once.values())
        kept = [h if h is not None and once[h] == i else None for i, h in enumerate(hashes)]
        features, values = [None] * len(texts), [None] * len(texts)
        if len(chosen):
            doc, feature, value = Features([texts[i] for i in chosen]).hashed()
            edges = np.searchsorted(doc, np.arange(len(chosen) + 1))
            for k, i in enumerate(chosen):
                features[i], values[i] = feature[edges[k] : edges[k + 1]], value[edges[k] : edges[k + 1]]
        columns = [pa.array(votes, pa.int32()), pa.array(kept, pa.int64()), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["votes", "hash", "feature", "value"])


def _scores(texts: pa.Array, model: tuple) -> pa.Array:
    """quality, weak_posterior and votes of each text, in slices that bound the memory."""
    weights, offset, posterior = model
    out = [np.zeros((0, 3))]
    for part in sliced([pa.RecordBatch.from_arrays([texts], ["t"])], "t"):
        found = Features(part.column("t").to_pylist())
        doc, feature, value = found.hashed()
        score = np.bincount(doc, value * weights[feature], found.n) + offset
        score = np.where(found.n_words > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0)
        votes = found.votes() @ _POWERS
        out.append(np.stack([score, posterior[votes], votes], axis=1))
    score, weak, votes = np.concatenate(out).T
    return pa.StructArray.from_arrays([pa.array(score), pa.array(weak), pa.array(votes.astype(np.int32))], ["quality", "weak_posterior", "votes"])


class QualityModel:
    """A fitted classifier: the labellers' accuracies, each vote pattern's posterior, and the scorer's weights."""

    def __init__(self, accuracy: np.ndarray, prior: float, posterior: np.ndarray, weights: np.ndarray, offset: float):
        self.accuracy, self.prior, self.posterior, self.weights, self.offset = accuracy, prior, posterior, weights, offset

    def score(self, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """Columns `keep` (by default all but those of the same names) with quality, weak_posterior and votes.

        Only the texts go to Python, and three numbers come back; the other columns stay in the JVM. The model takes under
        1 MB in each task.
        """
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.offset, self.posterior))

        def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in parts:
                yield _scores(texts, shared.value)

        # not to be computed again where a filter is pushed down
        scored = F.arrow_udf(score, "quality double, weak_posterior double, votes int").asNondeterministic()
        keep = [c for c in docs.columns if c not in ("quality", "weak_posterior", "votes")] if keep is None else list(keep)
        found = docs.select(F.struct(*keep).alias("_row"), scored(F.col(text_col)).alias("_q"))
        return found.select("_row.*", "_q.quality", "_q.weak_posterior", "_q.votes")


def fit_quality(docs: DataFrame, text_col: str = "text", max_train: int = 8192, seed: int = 7) -> QualityModel:
    """Fits on all documents' votes; the scorer on at most `max_train` distinct texts."""
    scratch = Scratch(docs.sparkSession, "quality")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text, F.lit(seed))
    # about twice as many rows as are wanted; of them, the texts with the least hashes are taken
    share = min(1.0, 2 * max_train / max(1, docs.count()))
    chosen = F.when(F.shiftrightunsigned(key, 34) <= int(share * (1 << 30)), F.shiftrightunsigned(key, 1))
    voted = scratch.table(docs.select(text.alias("t"), chosen.alias("hash")).mapInArrow(_voted, _VOTED), "votes")
    found = voted.groupBy("votes").count().collect()
    index = np.array([r["votes"] for r in found], dtype=np.int64)
    patterns = index[:, None] // _POWERS % 3
    fine, accuracy, prior = fit_votes(patterns, np.array([r["count"] for r in found], dtype=float)) if found else (np.zeros(0), np.zeros((2, 0, 2)), 0.5)
    posterior = np.full(3 ** len(_LABELLERS), prior)
    posterior[index] = fine
    distinct = voted.where("hash is not null").groupBy("hash").agg(F.any_value(F.struct("votes", "feature", "value")).alias("row"))
    sample = distinct.orderBy("hash").limit(max_train).select("row.*").collect()
    target = np.array([posterior[r["votes"]] for r in sample])
    features = [(np.array(r["feature"], dtype=np.int64), np.array(r["value"], dtype=float)) for r in sample]
    weights, offset = fit_scorer(features, target)
    scratch.drop("votes")
    return QualityModel(accuracy, prior, posterior, weights.astype(np.float32), float(offset))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Per document: id, quality, weak_posterior, votes and accepted."""
    model = fit_quality(docs, text_col, **options)
    return model.score(docs, text_col, keep=[id_col]).withColumn("accepted", F.col("quality") >= threshold)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of `docs` that are accepted, with their columns."""
    model = fit_quality(docs, text_col, **options)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return model.score(whole, "_text").where(F.col("quality") >= threshold).select("_row.*")
