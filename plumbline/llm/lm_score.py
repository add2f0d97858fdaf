"""Masked pseudo-likelihood of documents under a bidirectional window network and the whole corpus' word counts.

A token is a lower-cased word. Each is masked in turn and predicted from the `width` words on either side; the sum of the log-probabilities
scores the document.

1. Count. All words of all documents, by their 64-bit hashes, in a table that grows with the corpus. The network knows the words
   above a frequency, of at least `min_count`, that at most `vocabulary` words reach. Their neighbours in all documents, counted in a
   second pass, arrange them into classes of equal size.
2. Train. The network embeds the neighbours, weighs them by their places, adds them, and has one hidden layer and levels of softmax:
   over the classes and one class of all other words, over the words of the class, and over 256 hashed groups of the other words (16, then 16 in
   each). Many classes are split into sets of 8 and large ones into parts of 32 words, each with a softmax of its own, so that a token of 8,192
   words meets 53 outputs and not 193. Every token of every document is predicted, as often as it occurs: one task begins on some `alone` tokens, and in `rounds` jobs all others follow, in tasks
   that start from common weights; their weights are averaged by their tokens. A corpus of at most `alone` tokens is one task's.
3. Score. Every token has a probability, in each context they add up to 1 over all words of the corpus. A word that the network knows has the
   product of its class and its place there; another word that of the other words, its group, and its share in the group: its count in all
   documents less 0.95, so that what was seen only here is little evidence, by the sum of those in the group. For common words, with more than
   `few` occurrences and more than 1/`common` of all, counts are sent along. The occurrences of all rarer words meet by word, so no task gets
   a hot word, and whatever the corpus repeats, however rarely, is seen.

What is bounded: the network (vocabulary, classes, weights) and the common words that are broadcast; counts and what the network is trained
on aren't. As in any training by parts, weights depend on how the table is split into tasks (by partitions, tokens and the cluster's cores); an equal split
gives equal weights. Null,
empty and wordless texts have no tokens, a log-likelihood of 0 and no mean. Texts may be of any length. Repeated rows count as often as
they occur and get equal scores; ties in frequency go by hash. Columns other than the two named are ignored, and an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from copy import copy
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from plumbline.llm.textkit import bound_batches, mix64, sliced, words_of
from plumbline.plans.storage import Scratch

_STRETCH = 64
_BUCKETS = 4096
_GROUPS = 256
_SETS = 16
_PIECE = 1024
_CHUNK = 1 << 14
_SCORED_AT_ONCE = 1 << 15
_FULL = 1 << 22
_DISCOUNT = 0.95
_BLOCK = 1 << 14


# -- words -------------------------------------------------------------------------------------------------


def lay_out(ids: np.ndarray, first: np.ndarray, width: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with `width` edges around each text, and the place of each token among them."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids)) + width * (text + 1)
    out = np.full(len(ids) + width * len(first), edge, np.int64)
    out[place] = ids
    return out, place


_COUNTED = "word long, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "t"):
        words, n = np.unique(words_of(batch.column("t").to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _stretches(batches: Iterator[pa.RecordBatch], width: int, limit: int = 1 << 53) -> Iterator[pa.RecordBatch]:
    """Stretches of words whose content's hash is below a limit (all, without one), with `width` words (0: an edge) on either side."""
    for batch in sliced(batches, "t"):
        words, first = words_of(batch.column("t").to_pylist())
        n = np.diff(first)
        pieces = -(-n // _STRETCH)
        owner = np.repeat(np.arange(len(n)), pieces)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[:-1][owner] + turn * _STRETCH
        if not len(start):
            continue
        at = (np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))).astype(np.uint64)
        content = mix64(np.add.reduceat(mix64(words + at), start)) >> np.uint64(11)
        padded, place = lay_out(words.view(np.int64), first, width, 0)
        chosen = np.flatnonzero(content < limit)
        a, z = start[chosen], np.minimum(start[chosen] + _STRETCH, first[owner[chosen] + 1])
        ends = np.cumsum(z - a + 2 * width)
        # a text's words and the edges around them lie in one run
        rows = padded[np.arange(ends[-1] if len(ends) else 0) + np.repeat(place[a] - width - np.append(0, ends[:-1]), z - a + 2 * width)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(rows))
        yield pa.RecordBatch.from_arrays([pa.array(content[chosen].astype(np.int64)), lists], ["hash", "words"])


def class_size(words: int, classes: int) -> int:
    """Places in a class; large classes hold whole parts of 32."""
    size = max(1, -(-words // classes))
    return size if size <= 32 else -(-size // 32) * 32


class Vocabulary:
    """The network's words. A word's id is class * size + its place in the class; other words share ids behind these, and the last is the edge.
    `tree`: the branches at each level of softmax on the way to a word. Many classes have a level of sets of 8 above them, large classes one of parts of 32 words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, order: np.ndarray, max_classes: int):
        """words: hashes; order: the words' indices, neighbours alike beside each other."""
        self.classes = max(1, min(max_classes, len(words) // 8))
        self.size = class_size(len(words), self.classes)
        self.tree = [self.classes // 8, 8] if self.classes > 16 and self.classes % 8 == 0 else [self.classes]
        self.tree += [self.size // 32, 32] if self.size > 32 else [self.size]
        ids = np.empty(len(words), np.int64)
        ids[order] = np.arange(len(words))
        at = np.argsort(words)
        self.words, self.ids = words[at], ids[at]
        # where the words of each first 16 bits begin, and how many share them at most
        self.starts = np.searchsorted(self.words >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.bincount((self.words >> np.uint64(48)).astype(np.int64)).max()) if len(words) else 0
        self.known = self.classes * self.size
        self.edge = self.known + _BUCKETS
        self.counts = np.zeros(self.known)
        self.counts[ids] = counts

    def ids_of(self, words: np.ndarray) -> np.ndarray:
        others = self.known + (words % np.uint64(_BUCKETS)).astype(np.int64)
        if not len(self.words):
            return others
        at = self.starts[(words >> np.uint64(48)).astype(np.int64)]
        beyond = np.append(self.words, np.uint64((1 << 64) - 1))
        for _ in range(self.steps):
            at += beyond[at] < words
        at = np.minimum(at, len(self.words) - 1)
        return np.where(self.words[at] == words, self.ids[at], others)


def arrange(profiles: np.ndarray, size: int) -> np.ndarray:
    """An order in which rows alike are near each other: halved along the main direction until `size` are left."""
    out, open_ = [], [np.arange(len(profiles))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = profiles[rows] - profiles[rows].mean(0)
        direction = np.ones(own.shape[1]) + 0.1 * np.arange(own.shape[1])
        for _ in range(12):
            direction = own.T @ (own @ direction)
            direction /= np.linalg.norm(direction) + 1e-12
        rows = rows[np.argsort(own @ direction, kind="stable")]
        half = -(-len(rows) // 2 // size) * size if len(rows) > size else len(rows)
        open_ += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_BLOCKS = "block int, part binary"


def _blocks(vector: np.ndarray) -> pa.RecordBatch:
    parts = [vector[a : a + _BLOCK].tobytes() for a in range(0, len(vector), _BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])


def _added(batches: Iterator[pa.RecordBatch], dtype: type) -> Iterator[pa.RecordBatch]:
    """For one partition of blocks: the sum of all vectors' blocks of each number, taken one after the other."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("part"), strict=True):
            own = np.frombuffer(part.as_buffer(), dtype)
            if block in sums:
                sums[block] += own
            else:
                sums[block] = own.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], ["block", "part"])


def sum_vectors(vectors: DataFrame, size: int, dtype: type) -> np.ndarray:
    """The sum of the vectors that tasks gave as blocks; zeros without any."""
    out = np.zeros(size)
    summed = vectors.repartition(max(1, -(-size // (8 * _BLOCK))), "block").mapInArrow(partial(_added, dtype=dtype), _BLOCKS).toArrow()
    for block, part in zip(summed.column("block").to_pylist(), summed.column("part").to_pylist(), strict=True):
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(part)
    return out


def _profiled(batches: Iterator[pa.RecordBatch], words: np.ndarray, neighbours: int) -> Iterator[pa.RecordBatch]:
    at = np.argsort(words)
    ordered = words[at]
    # ranks of words, of others and of edges; edges count among the others
    rank = np.full(len(words) + 2, neighbours, np.int64)
    rank[:neighbours] = np.arange(min(neighbours, len(words) + 2))
    rank[len(words) :] = neighbours
    span = 2 * (neighbours + 1)
    out = np.zeros(len(words) * span, np.int64)
    for batch in sliced(batches, "t"):
        found, first = words_of(batch.column("t").to_pylist())
        place = np.minimum(np.searchsorted(ordered, found), len(words) - 1)
        laid, place = lay_out(np.where(ordered[place] == found, at[place], len(words)), first, 1, len(words) + 1)
        place = place[laid[place] < len(words)]
        own = laid[place] * span
        np.add.at(out, np.concatenate([own + rank[laid[place - 1]], own + neighbours + 1 + rank[laid[place + 1]]]), 1)
    yield _blocks(out)


def profiles_of(texts: DataFrame, words: np.ndarray, neighbours: int = 96) -> np.ndarray:
    """For each word, the roots of the shares of the first words, and of all others, on its left and its right in all texts."""
    vectors = texts.mapInArrow(partial(_profiled, words=words, neighbours=neighbours), _BLOCKS)
    out = sum_vectors(vectors, len(words) * 2 * (neighbours + 1), np.int64).reshape(len(words), -1)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


# -- network ------------------------------------------------------------------------------------------------


def _exponentials(z: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Writes exp(z - shift) to e; its sums by row, and the shifts: 0, unless a row is too large or too small for that."""
    np.exp(z, out=e)
    sums = e @ np.ones(e.shape[1], e.dtype)
    if sums.min() > 1e-25 and sums.max() < 1e25:
        return sums, 0.0
    shift = z.max(1)
    np.exp(z - shift[:, None], out=e)
    return e.sum(1), shift


class _Space:
    """Arrays that each step uses again: touching fresh memory takes longer than the arithmetic on it."""

    def __init__(self, dtype: type):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, rows: int, columns: int, dtype: type | None = None) -> np.ndarray:
        own = self.held.get(name)
        if own is None or own.size < rows * columns:
            own = self.held[name] = np.empty(rows * columns * 5 // 4, dtype or self.dtype)
        return own[: rows * columns].reshape(rows, columns)


class WindowNetwork:
    """Embeddings weighed by place and added, one hidden layer, a softmax over classes (or sets of them) and the other words, those over the
    branches of each down to the words, and one over the sets of the other words' groups and over the groups of each."""

    def __init__(self, vocabulary: Vocabulary, others: float | np.ndarray, width: int = 3, embed: int = 40, hidden: int = 48, seed: int = 11, dtype=np.float32):
        """others: occurrences of words that the vocabulary doesn't have, in all or by group. Begins as the unigram model."""
        groups = np.broadcast_to(np.asarray(others, float) / (1 if np.ndim(others) else _GROUPS), _GROUPS)
        v, rng = vocabulary, np.random.default_rng(seed)
        self.vocabulary, self.width = v, width
        self.inner = [*(f"branch{i}" for i in range(1, len(v.tree) - 1)), "word"]
        self.offsets = [*range(-width, 0), *range(1, width + 1)]
        # counts of the branches at each level, by what they branch from
        by_level = [v.counts.reshape(int(np.prod(v.tree[:i])), b, -1).sum(2) for i, b in enumerate(v.tree)]
        shares = np.append(by_level[0].sum(0), groups.sum()) + 1.0
        # places and groups without a word are as good as impossible
        logs = lambda n: np.where(n > 0, np.log(np.maximum(n, 1e-9) / max(n.sum(), 1e-9)), -1e4)
        init = lambda *shape, scale=0.1: rng.normal(0, scale, shape)
        weights = {
            "embed": init(v.edge + 1, embed, scale=0.3),
            "mix": np.repeat(np.array([[1.0 / abs(k)] for k in self.offsets]), embed, 1),
            "hidden": init(embed, hidden, scale=0.3),
            "hidden_bias": np.zeros(hidden),
            "class": init(hidden, v.tree[0] + 1),
            "class_bias": np.append(np.log(shares[:-1] / shares.sum()), np.log(shares[-1] / shares.sum()) if groups.sum() else -1e4),
            "set": init(_SETS, hidden),
            "set_bias": logs(groups.reshape(_SETS, -1).sum(1)),
            "group": init(_SETS, _GROUPS // _SETS, hidden),
            "group_bias": np.stack([logs(own) for own in groups.reshape(_SETS, -1)]),
        }
        for name, own in zip(self.inner, by_level[1:], strict=True):
            weights[name] = init(*own.shape, hidden)
            weights[f"{name}_bias"] = np.where(own > 0, np.log(np.maximum(own, 1) / np.maximum(own.sum(1, keepdims=True), 1)), -1e4)
        self.weights = {k: w.astype(dtype) for k, w in weights.items()}

    def _mixes(self) -> np.ndarray:
        """For each offset its weights, once for each position of a piece: products of whole arrays are faster than of their rows."""
        return np.repeat(self.weights["mix"][:, None], _PIECE, 1)

    def _hidden(self, laid: np.ndarray, place: np.ndarray, mixes: np.ndarray, space: _Space, kept: bool) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """The hidden layer at each place, and by pieces of positions, small enough for a core's cache: (from, to, the embedded run
        of these and their neighbours, for each position its neighbours' weighed sum), which are overwritten unless kept."""
        w, k, dims = self.weights, self.width, self.weights["embed"].shape[1]
        h, pieces = space("plain", len(place), len(w["hidden_bias"])), []
        begin, end = int(place[0]), int(place[-1]) + 1
        cuts = [*range(begin, end, _PIECE), end]
        at = np.searchsorted(place, cuts).tolist()
        rows = end - begin if kept else _PIECE
        runs, sums = space("runs", rows + 2 * k * len(cuts), dims), space("sums", rows, dims)
        for p, (a, z, i, j) in enumerate(zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True)):
            if i == j:
                continue
            n, first = z - a, (a - begin if kept else 0)
            run, x, own = runs[first + 2 * k * p : first + 2 * k * (p + 1) + n], sums[first : first + n], space("product", n, dims)
            w["embed"].take(laid[a - k : z + k], axis=0, out=run, mode="clip")
            np.multiply(run[:n], mixes[0, :n], out=x)
            for offset, mix in zip(self.offsets[1:], mixes[1:], strict=True):
                x += np.multiply(run[k + offset : k + offset + n], mix[:n], out=own)
            own = np.matmul(x, w["hidden"], out=space("linear", n, h.shape[1])).take(place[i:j] - a, axis=0, out=h[i:j], mode="clip")
            own += w["hidden_bias"]
            np.tanh(own, out=own)
            pieces.append((a, z, run, x))
        return h, pieces

    def _order(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[str, list[int], np.ndarray]]]:
        """An order of the targets by last branch and set, and the levels of softmax they pass in it: (weights, where the rows of each of the
        level's softmaxes begin and the last's end, the outputs of these rows)."""
        v, sets = self.vocabulary, _GROUPS // _SETS
        last = v.known // v.tree[-1]
        target = target.astype(np.int32)
        others = (target - v.known) % _GROUPS
        own = np.where(target < v.known, target // v.tree[-1], last + others // sets).astype(np.int16)
        order = np.argsort(own, kind="stable")
        own, target = own[order], target[order]
        edges = np.searchsorted(own, np.arange(last + _SETS + 1)).tolist()
        known, n = edges[last], len(own)
        levels = [("class", [0, n], np.minimum(target // (v.known // v.tree[0]), v.tree[0])), ("set", [known, n], own[known:] - last)]
        above, below = 1, v.known
        for i, name in enumerate(self.inner):
            above, below = above * v.tree[i], below // v.tree[i]
            levels.append((name, edges[: last + 1 : last // above], target[:known] // (below // v.tree[i + 1]) % v.tree[i + 1]))
        levels.append(("group", edges[last:], others[order[known:]] % sets))
        return order, [level for level in levels if len(level[2])]

    def _joined(self) -> dict[str, np.ndarray]:
        """The weights of each level's softmaxes, (softmaxes, outputs, hidden + 1): the biases stand behind the others."""
        w = self.weights
        own = {"class": w["class"].T[None], "set": w["set"][None], **{name: w[name] for name in ("group", *self.inner)}}
        return {name: np.concatenate([part, w[f"{name}_bias"].reshape(*part.shape[:2], 1)], 2) for name, part in own.items()}

    @staticmethod
    def _exponents(h: np.ndarray, joined: np.ndarray, edges: list[int], space: _Space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | float]:
        """Of all rows of a level: their logits, the exponentials of these, less shifts, and the sums and shifts by row."""
        logits = space("logits", edges[-1] - edges[0], joined.shape[1])
        for c, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if z > a:
                np.matmul(h[a:z], joined[c].T, out=logits[a - edges[0] : z - edges[0]])
        e = space("exponentials", *logits.shape)
        return logits, e, *_exponentials(logits, e)

    def log_probabilities(self, laid: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each token given its neighbours; of a word that isn't in the vocabulary, that of its group. Places ascend and lie close."""
        out, mixes, joined = np.zeros(len(place)), self._mixes(), self._joined()
        space = _Space(self.weights["embed"].dtype)
        for at in range(0, len(place), _SCORED_AT_ONCE):
            own = place[at : at + _SCORED_AT_ONCE]
            order, levels = self._order(laid[own])
            h = self._ordered(self._hidden(laid, own, mixes, space, False)[0], order, space)
            lp = np.zeros(len(own))
            for name, edges, outputs in levels:
                logits, _, sums, shift = self._exponents(h, joined[name], edges, space)
                lp[edges[0] : edges[-1]] += logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + outputs] - shift - np.log(sums)
            out[at + order] = lp
        return out

    @staticmethod
    def _ordered(plain: np.ndarray, order: np.ndarray, space: _Space) -> np.ndarray:
        """The hidden layer in an order, and behind it ones for the biases."""
        n, width = plain.shape
        h = space("hidden", n, width + 1)
        h[:, :width] = plain.take(order, axis=0, out=space("ordered", n, width), mode="clip")
        h[:, width] = 1
        return h

    def _gradients(self, laid: np.ndarray, place: np.ndarray, flat: np.ndarray, space: _Space, losses: bool = True) -> float:
        """The gradients of the sum of the tokens' negative log-likelihoods are written to a vector. That sum, if asked for."""
        w, g, k = self.weights, self._views(flat), self.width
        flat[:] = 0
        order, levels = self._order(laid[place])
        mixes = self._mixes()
        joined = self._joined()
        slopes = {name: np.zeros_like(own) for name, own in joined.items()}
        plain, pieces = self._hidden(laid, place, mixes, space, True)
        n, width = plain.shape
        h, loss = self._ordered(plain, order, space), 0.0
        # a row of zeros, for positions between the places
        dh = space("back", n + 1, width)
        dh[n] = 0
        for name, edges, outputs in levels:
            first, end = edges[0], edges[-1]
            logits, d, sums, shift = self._exponents(h, joined[name], edges, space)
            own = np.arange(0, d.size, d.shape[1]) + outputs
            if losses:
                loss += float((np.log(sums) + shift - logits.ravel()[own]).sum())
            # the slopes times the sums, which are divided out where fewer numbers hold them
            d.ravel()[own] -= sums
            share = (1 / sums)[:, None]
            shared = np.multiply(h[first:end], share, out=space("shared", end - first, width + 1))
            back = space("ordered", end - first, width)
            for c, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if z > a:
                    part = d[a - first : z - first]
                    np.matmul(part.T, shared[a - first : z - first], out=slopes[name][c])
                    np.matmul(part, joined[name][c, :, :width], out=back[a - first : z - first])
            if name == "class":
                np.multiply(back, share, out=dh[:n])
            else:
                back *= share
                dh[first:end] += back
        for name, own in slopes.items():
            g[name][:] = own[0, :, :width].T if name == "class" else own[..., :width].reshape(g[name].shape)
            g[f"{name}_bias"][:] = own[..., width].reshape(g[f"{name}_bias"].shape)
        turned = space("ordered", n, width)
        np.multiply(h[:, :width], h[:, :width], out=turned)
        np.subtract(1, turned, out=turned)
        dh[:n] *= turned
        g["hidden_bias"][:] = np.ones(n, dh.dtype) @ dh[:n]
        begin, dims = int(place[0]), np.arange(w["embed"].shape[1])
        turn = np.full(int(place[-1]) + 1 - begin, n)
        turn[place[order] - begin] = np.arange(n)
        for a, z, run, x in pieces:
            size = z - a
            dz = dh.take(turn[a - begin : z - begin], axis=0, out=space("linear", size, width), mode="clip")
            g["hidden"] += x.T @ dz
            dx = np.matmul(dz, w["hidden"].T, out=space("dx", *x.shape))
            product, by_place, ones = space("product", *x.shape), space("by_place", *run.shape), np.ones(size, dx.dtype)
            by_place[:] = 0
            for o, (offset, mix) in enumerate(zip(self.offsets, mixes, strict=True)):
                own = slice(k + offset, k + offset + size)
                g["mix"][o] += ones @ np.multiply(dx, run[own], out=product)
                by_place[own] += np.multiply(dx, mix[:size], out=product)
            at = np.add(laid[a - k : z + k, None] * len(dims), dims, out=space("at", *run.shape, dtype=np.int64))
            np.add.at(g["embed"].reshape(-1), at.reshape(-1), by_place.reshape(-1))
        return loss

    def loss_and_gradients(self, laid: np.ndarray, place: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tokens at these places, which ascend and lie close, and its gradients."""
        flat = np.zeros_like(self.vector())
        loss = self._gradients(laid, place, flat, _Space(flat.dtype))
        flat /= len(place)
        return loss / len(place), self._views(flat)

    def fit(self, batches: Iterable[tuple[np.ndarray, np.ndarray]], rate: Callable[[int], float], warm_up: int = 10) -> int:
        """Adam over (ids, places). rate: by the number of tokens before. Returns the number of tokens."""
        flat = self.vector()
        self.weights = self._views(flat)
        g, m, v = np.zeros_like(flat), np.zeros_like(flat), np.full_like(flat, 1e-16)
        seen, space = 0, _Space(flat.dtype)
        for t, (laid, place) in enumerate(batches, 1):
            self._gradients(laid, place, g, space, losses=False)
            # moments are plain sums of what has faded by 0.9 and 0.999 a step
            scale = rate(seen) * min(1.0, t / warm_up) * 0.1 / (1 - 0.9**t) * np.sqrt((1 - 0.999**t) / 0.001)
            seen += len(place)
            for a in range(0, len(flat), _BLOCK):
                own = slice(a, a + _BLOCK)
                mean, square, slope = m[own], v[own], g[own]
                mean *= 0.9
                mean += slope
                slope *= slope
                square *= 0.999
                square += slope
                np.sqrt(square, out=slope)
                np.divide(mean, slope, out=slope)
                slope *= scale
                flat[own] -= slope
        return seen

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of a vector, shaped like the weights."""
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return out

    def vector(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def with_vector(self, vector: np.ndarray) -> WindowNetwork:
        """A network with these weights."""
        out = copy(self)
        out.weights = self._views(vector.astype(self.weights["embed"].dtype))
        return out


def _batched(stretches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, width: int, size: int, epochs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stretches as batches of about `size` tokens, eight at a time ordered by their contents' hashes; for several epochs all are held."""

    def dealt(own: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = [words for _, words in sorted(own, key=lambda pair: pair[0])]
        ends = np.cumsum([len(words) - 2 * width for words in own])
        parts = max(1, round(int(ends[-1]) / size))
        borders = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, parts + 1) / parts, side="left") + 1).tolist()
        for a, z in zip([0, *borders[:-1]], borders, strict=True):
            yield training_places(own[a:z], vocabulary, width)

    held, tokens = [], 0
    for batch in stretches:
        words = batch.column("words")
        values, offsets = words.values.to_numpy(), words.offsets.to_numpy()
        pairs = list(zip(batch.column("hash").to_pylist(), np.split(values, offsets[1:-1]), strict=True))
        held += pairs
        tokens += len(values) - 2 * width * len(pairs)
        if epochs == 1 and tokens >= 8 * size:
            yield from dealt(held)
            held, tokens = [], 0
    for _ in range(epochs if held else 0):
        yield from dealt(held)


def _trained(batches: Iterator[pa.RecordBatch], network: Broadcast, size: int, epochs: int, rate: Callable[[int], float]) -> Iterator[pa.RecordBatch]:
    """A task's weights times its tokens, and its tokens."""
    own = network.value.with_vector(network.value.vector())
    seen = own.fit(_batched(_stretches(batches, own.width), own.vocabulary, own.width, size, epochs), rate)
    if seen:
        yield _blocks(np.append(own.vector() * np.float32(seen), np.float32(seen)))


def _falling(seen: int, highest: float, start: float, stop: float, expected: float) -> float:
    """A rate that falls from 1 - start to 1 - stop of the highest."""
    return highest * (1 - start - (stop - start) * min(1.0, seen / expected))


def task_count(tokens: float, partitions: int, cores: int, alone: int) -> int:
    """Tasks that share a job's tokens: of `_FULL` tokens, which fill their batches, or more; of less only so that no core idles, and never of less than `alone`."""
    return max(1, min(partitions, int(tokens // alone), max(cores, int(tokens // _FULL))))


def train(network: WindowNetwork, dealt: DataFrame, tokens: int, epochs: int, alone: int, rounds: int, rate: float = 0.004) -> WindowNetwork:
    """The network after `epochs` passes over all texts, every token once a pass. dealt: texts t and turns, shares of 1. One task begins on the rows of the first share, some `alone`
    tokens; those of the other rounds are dealt to tasks of as many tokens or more (see `task_count`)."""
    spark = dealt.sparkSession
    if not tokens or not epochs:
        return network
    if tokens <= alone:
        shares, inner, passes = [0.0, 1.0], epochs, 1
    else:
        first = alone / tokens
        shares, inner, passes = [0.0, *(first + (1 - first) * np.arange(rounds + 1) / rounds).tolist()], 1, epochs
    for p in range(passes):
        for low, high in zip(shares[:-1], shares[1:], strict=True):
            share = tokens * (high - low)
            tasks = task_count(share, dealt.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism, alone)
            step = partial(_falling, highest=rate, start=(p + low) / passes, stop=(p + high) / passes, expected=inner * share / tasks)
            sent = spark.sparkContext.broadcast(network)
            task = partial(_trained, network=sent, size=int(np.clip(share / tasks / 256, 512, _CHUNK)), epochs=inner, rate=step)
            rows = dealt.where((F.col("turn") >= low) & (F.col("turn") < high))
            # one task gets its rows from all that read them; it doesn't read the whole table
            rows = rows.repartition(1).sortWithinPartitions("turn") if tasks == 1 else rows.coalesce(tasks)
            vector = network.vector()
            total = sum_vectors(rows.select("t").mapInArrow(task, _BLOCKS), len(vector) + 1, np.float32)
            if total[-1]:
                network = network.with_vector(total[:-1] / total[-1])
            sent.unpersist()
    return network


# -- the model -----------------------------------------------------------------------------------------------


class LanguageModel:
    """The network, the sums of the other words' weights by group, and the counts of the common ones among them."""

    def __init__(self, network: WindowNetwork, common: np.ndarray, counts: np.ndarray, sums: np.ndarray, others: int):
        """common: hashes, ascending; sums: of `weight` over all words outside the vocabulary, by group; others: their occurrences."""
        self.network, self.common, self.others = network, common, others
        self.sums = np.log(np.maximum(sums, 1e-300))
        self.common_logs = self.share(common, counts)

    @staticmethod
    def weight(counts: np.ndarray) -> np.ndarray:
        return counts - _DISCOUNT

    def share(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logs of words' shares in their groups."""
        return np.log(self.weight(counts)) - self.sums[(words & np.uint64(_GROUPS - 1)).astype(np.int64)]

    def known(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens; log-likelihoods but for the shares of rare words; each text's first rare word (one more at the end),
        and the rare words."""
        words, first = words_of(texts)
        v = self.network.vocabulary
        ids = v.ids_of(words)
        lp = self.network.log_probabilities(*lay_out(ids, first, self.network.width, v.edge))
        other = np.flatnonzero(ids >= v.known)
        at = np.minimum(np.searchsorted(self.common, words[other]), max(0, len(self.common) - 1))
        frequent = self.common[at] == words[other] if len(self.common) else np.zeros(len(other), bool)
        lp[other[frequent]] += self.common_logs[at[frequent]]
        rare = other[~frequent]
        run = np.concatenate([[0.0], np.cumsum(lp)])
        return np.diff(first), np.diff(run[first]), np.searchsorted(rare, first), words[rare].view(np.int64)

    def rare(self, word: np.ndarray) -> np.ndarray:
        """Log of each occurrence's share in its group, given all occurrences of these words."""
        return self.share(word.view(np.uint64), _multiplicity(word))


def _multiplicity(key: np.ndarray) -> np.ndarray:
    """How many rows have each row's key."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at] if len(key) else np.zeros(0, np.int64)


_SCORED = "row long, id long, n_tokens long, ll double, rare array<long>"


def _scored(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "t"):
        n, ll, at, rare = model.value.known(batch.column("t").to_pylist())
        words = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(rare))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(n), pa.array(ll), words], ["row", "id", "n_tokens", "ll", "rare"])


def _settled(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """For one partition of rare words: what each occurrence adds to its row. Spark sums them by row before they are shuffled."""
    parts = [[b.column(c).to_numpy() for c in ("row", "word")] for b in batches if b.num_rows]
    if parts:
        row, word = (np.concatenate(p) for p in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(model.value.rare(word))], ["row", "more"])


def least_count(counts: DataFrame, at_most: int) -> int:
    """The least frequency that at most `at_most` words reach, to within a step of an eighth of an octave."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["step"]: r["words"] for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > at_most:
            break
        least = s
    # the smallest whole number of the last step that fits
    return 1 << 62 if least is None else next(n for n in range(max(1, int(2 ** (least / 8)) - 1), int(2 ** ((least + 1) / 8)) + 2) if int(np.floor(np.log2(n) * 8)) >= least)


def fit_lm(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: int = 8192,
    min_count: int = 5,
    few: int = 64,
    common: int = 1 << 19,
    max_classes: int = 64,
    epochs: int | None = None,
    width: int = 3,
    alone: int = 1 << 20,
    rounds: int = 3,
    **network_options,
) -> LanguageModel:
    """Counts over all documents, and the network trained on all of them. epochs: passes; by default one, and up to three over fewer than
    1.5 million tokens."""
    scratch = Scratch(docs.sparkSession, "lm-counts")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("t")).where("t is not null")
    counts = scratch.table(texts.mapInArrow(_count_words, _COUNTED).groupBy("word").agg(F.sum("n").alias("n")), "counts")
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most `vocabulary` words reach the first of these frequencies, and fewer than `common` the second
    known_from, common_from = max(min_count, least_count(counts, vocabulary)), max(few, tokens // common) + 1
    top = counts.where(F.col("n") >= min(known_from, common_from)).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    known, rest = n >= known_from, (n < known_from) & (n >= common_from)
    group = F.col("word").bitwiseAND(F.lit(_GROUPS - 1)).cast("int")
    groups = counts.where(F.col("n") < known_from).groupBy(group.alias("g")).agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.lit(_DISCOUNT)).alias("w")).toArrow()
    others, sums = np.zeros((2, _GROUPS))
    others[groups.column("g").to_numpy()], sums[groups.column("g").to_numpy()] = groups.column("n").to_numpy(), groups.column("w").to_numpy()
    by_count = np.argsort(-n[known], kind="stable")
    words_known, n_known = words[known][by_count], n[known][by_count]
    classes = max(1, min(max_classes, len(words_known) // 8))
    order = arrange(profiles_of(texts, words_known), class_size(len(words_known), classes)) if len(words_known) else np.zeros(0, np.int64)
    network = WindowNetwork(Vocabulary(words_known, n_known, order, max_classes), others, width, **network_options)
    passes = min(3, max(1, -(-1_572_864 // max(1, tokens)))) if epochs is None else epochs
    # by all that a row holds, not by its place, so that each has one turn in whatever order it comes, and copies under other ids have others
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    turn = F.pmod(F.xxhash64(*plain), F.lit(1 << 30)) / F.lit(float(1 << 30))
    dealt = docs.select(F.col(text_col).alias("t"), turn.alias("turn")).where("t is not null")
    network = train(network, dealt, tokens, passes, alone, rounds)
    model = LanguageModel(network, words[rest], n[rest], sums, int(others.sum()))
    scratch.drop("counts")
    return model


def training_places(sample: list[np.ndarray], vocabulary: Vocabulary, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all stretches after each other, and the places of the words to predict: all but those around a stretch."""
    if not sample:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(s) for s in sample])
    words = np.concatenate(sample)
    ids = np.where(words == 0, vocabulary.edge, vocabulary.ids_of(words.view(np.uint64)))
    return ids, np.concatenate([np.arange(e - len(s) + width, e - width) for s, e in zip(sample, ends, strict=True)])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 2_000_000, **options) -> DataFrame:
    """Per row: id_col, n_tokens, log_likelihood (summed over its tokens) and mean_log_likelihood (null without tokens)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    fitted = fit_lm(docs, text_col, **options)
    model = spark.sparkContext.broadcast(fitted)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    scored = scratch.table(source.mapInArrow(partial(_scored, model=model), _SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fitted.others // rows_per_part))
    more = rare.repartition(parts, "word").mapInArrow(partial(_settled, model=model), "row long, more double").groupBy("row").agg(F.sum("more").alias("more"))
    whole = scored.select("row", "id", "n_tokens", "ll").join(more, "row", "left")
    total = F.col("ll") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return whole.select(F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
