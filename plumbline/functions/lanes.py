"""Least squares and logistic regression on cells (combinations of factor levels), for many sets of weights at once.

A lane is one set of weights on the same cells: a replicate of a bootstrap, say. Arrays have a row for each lane and a column for each
cell, and all lanes are solved together. The factor with most levels is eliminated level by level, so what is solved is a system
of the other terms only; where those are many, too, conjugate gradients never form a matrix.

Where terms determine each other, the coefficients are the least ones: of all solutions the one with the least sum of squares,
each times its own column's sum of squares. That rule holds for every way of solving and every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

Sums = Mapping[str, np.ndarray]

#: With more terms than this beside the largest factor, conjugate gradients are cheaper than the system itself.
_DIRECT = 64
#: Eigenvalues (of a system with unit columns) that count as 0.
_RANK = 1e-10


def least_solution(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Of all solutions of the normal equations (one system, or a stack of them) the least one by the rule above."""
    own = np.diagonal(gram, axis1=-2, axis2=-1)
    scale = np.where(own > 0, 1 / np.sqrt(np.where(own > 0, own, 1)), 0)
    value, vector = np.linalg.eigh(gram * scale[..., :, None] * scale[..., None, :])
    inverse = np.where(value > _RANK, 1 / np.where(value > _RANK, value, 1), 0)
    inner = np.einsum("...ij,...i->...j", vector, scale * moment) * inverse
    return scale * np.einsum("...ij,...j->...i", vector, inner)


class Segments:
    """Sums over cells by an index, for all lanes. Cells with a negative index don't count."""

    def __init__(self, index: np.ndarray, size: int):
        kept = np.flatnonzero(index >= 0)
        self.order = kept[np.argsort(index[kept], kind="stable")]
        self.own, self.starts = np.unique(index[self.order], return_index=True)
        self.size = size

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((*values.shape[:-1], self.size))
        if len(self.own):
            out[..., self.own] = np.add.reduceat(values[..., self.order], self.starts, axis=-1)
        return out


def conjugate_gradients(apply, moment: np.ndarray, own: np.ndarray, rounds: int = 2000, tol: float = 1e-13) -> np.ndarray:
    """The least solution of apply(x) = moment for each lane; `own` is the diagonal. From 0, with columns scaled to unit length."""
    scale = np.where(own > 0, 1 / np.sqrt(np.where(own > 0, own, 1)), 0)
    r = scale * moment
    x, d = np.zeros_like(r), r.copy()
    rr = (r * r).sum(-1)
    goal = tol * tol * rr
    best, stale = rr.copy(), 0
    for _ in range(rounds):
        if not (rr > goal).any():
            break
        q = scale * apply(scale * d)
        dq = (d * q).sum(-1)
        a = np.where(dq > 0, rr / np.where(dq > 0, dq, 1), 0)
        x, r = x + a[..., None] * d, r - a[..., None] * q
        new = (r * r).sum(-1)
        d = r + np.where(rr > 0, new / np.where(rr > 0, rr, 1), 0)[..., None] * d
        rr = new
        # rounding stops progress near the end; going on would only add noise
        stale = 0 if (rr < best * 0.99).any() else stale + 1
        best = np.minimum(best, rr)
        if stale >= 30:
            break
    return scale * x


class Lanes:
    """Cells with the terms of their levels: the intercept is term 0, `spans` are the ranges of the factors' terms, and numeric
    features are the last `numeric` of `terms`. `codes` has for each factor and cell the level's term, or -1 for the reference level.

    Sums per lane and cell: `n`, `s` (of the outcome), and for numeric features k <= l: `z{k}`, `z{k}s`, `z{k}z{l}`.
    """

    def __init__(self, codes: Sequence[np.ndarray], spans: Sequence[tuple[int, int]], terms: int, numeric: int = 0):
        self.codes, self.spans, self.terms, self.numeric = [np.asarray(c, np.int64) for c in codes], list(spans), terms, numeric
        self.first_numeric = terms - numeric
        self.by_term = [Segments(c, terms) for c in self.codes]
        widths = [b - a for a, b in self.spans]
        self.big = int(np.argmax(widths)) if widths else None

    def _moment(self, values: np.ndarray, zs: Sequence[np.ndarray]) -> np.ndarray:
        """X' of a value per cell; `zs` are the values' sums with the numeric features."""
        out = np.zeros((len(values), self.terms))
        out[:, 0] = values.sum(-1)
        for sums in self.by_term:
            out += sums(values)
        for k, z in enumerate(zs):
            out[:, self.first_numeric + k] = z.sum(-1)
        return out

    def own_squares(self, sums: Sums) -> np.ndarray:
        """Each term's weighted sum of squares."""
        return self._moment(sums["n"], [sums[f"z{k}z{k}"] for k in range(self.numeric)])

    def fitted(self, beta: np.ndarray) -> np.ndarray:
        """Per lane and cell, the part of the fit that its levels give."""
        extended = np.concatenate([beta, np.zeros((len(beta), 1))], axis=1)  # where the reference's code, -1, finds a 0
        out = np.repeat(beta[:, :1], len(self.codes[0]) if self.codes else 1, axis=1)
        for c in self.codes:
            out = out + extended[:, c]
        return out

    def apply(self, sums: Sums, beta: np.ndarray) -> np.ndarray:
        """X'WX beta, cell by cell."""
        n, fit, z = sums["n"], self.fitted(beta), beta[:, self.first_numeric :]
        at = lambda k, m: sums[f"z{min(k, m)}z{max(k, m)}"]
        value = n * fit + sum((z[:, k, None] * sums[f"z{k}"] for k in range(self.numeric)), np.zeros(1))
        return self._moment(value, [sums[f"z{k}"] * fit + sum(z[:, m, None] * at(k, m) for m in range(self.numeric)) for k in range(self.numeric)])

    def least_squares(self, sums: Sums) -> np.ndarray:
        """Coefficients of every lane."""
        beside = self.terms - 1 - (self.spans[self.big][1] - self.spans[self.big][0] if self.codes else 0)
        if beside > _DIRECT:
            moment = self._moment(sums["s"], [sums[f"z{k}s"] for k in range(self.numeric)])
            return conjugate_gradients(lambda beta: self.apply(sums, beta), moment, self.own_squares(sums))
        if not self.codes:
            return self._few(sums)
        step = max(1, 4_000_000 // max(1, (self.spans[self.big][1] - self.spans[self.big][0] + 1) * (beside + 1)))
        parts = [self._eliminated({k: v[lo : lo + step] for k, v in sums.items()}) for lo in range(0, len(sums["n"]), step)]
        return np.concatenate(parts) if parts else np.zeros((0, self.terms))

    def _few(self, sums: Sums) -> np.ndarray:
        """Without factors: the intercept and the numeric features."""
        total = lambda name: sums[name].sum(-1)
        gram = np.zeros((len(sums["n"]), self.terms, self.terms))
        gram[:, 0, 0] = total("n")
        for k in range(self.numeric):
            gram[:, 0, 1 + k] = gram[:, 1 + k, 0] = total(f"z{k}")
            for m in range(k, self.numeric):
                gram[:, 1 + k, 1 + m] = gram[:, 1 + m, 1 + k] = total(f"z{k}z{m}")
        return least_solution(gram, np.stack([total("s"), *(total(f"z{k}s") for k in range(self.numeric))], axis=1))

    def blocks(self, sums: Sums) -> tuple[np.ndarray, ...]:
        """For elimination: the levels of the largest factor that occur (its term, -1 for the reference), their weights and moments, their
        products with the other terms, and the other terms' own products and moments; those terms are `others`."""
        lanes, (a, z) = len(sums["n"]), self.spans[self.big]
        others = np.r_[1:a, z : self.terms]
        place = np.full(self.terms + 1, -1)
        place[others] = np.arange(len(others))
        q = len(others)
        own, level = np.unique(self.codes[self.big], return_inverse=True)
        by_level = Segments(level, len(own))
        d, md = by_level(sums["n"]), by_level(sums["s"])
        b, c, m = np.zeros((lanes, len(own), q)), np.zeros((lanes, q, q)), np.zeros((lanes, q))
        small = [place[code] for i, code in enumerate(self.codes) if i != self.big]
        for i, f in enumerate(small):
            b += Segments(np.where(f >= 0, level * q + f, -1), len(own) * q)(sums["n"]).reshape(b.shape)
            m += Segments(f, q)(sums["s"])
            for g in small[: i + 1]:
                both = Segments(np.where((f >= 0) & (g >= 0), f * q + g, -1), q * q)(sums["n"]).reshape(c.shape)
                c += both if g is f else both + both.transpose(0, 2, 1)
        for k in range(self.numeric):
            at = place[self.first_numeric + k]
            b[:, :, at] += by_level(sums[f"z{k}"])
            m[:, at] += sums[f"z{k}s"].sum(-1)
            for f in small:
                cross = Segments(f, q)(sums[f"z{k}"])
                c[:, at] += cross
                c[:, :, at] += cross
            for o in range(k, self.numeric):
                to = place[self.first_numeric + o]
                c[:, at, to] += sums[f"z{k}z{o}"].sum(-1)
                c[:, to, at] = c[:, at, to]
        return others, own, d, md, b, c, m

    def _eliminated(self, sums: Sums) -> np.ndarray:
        others, own, d, md, b, c, m = self.blocks(sums)
        inverse = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
        weighted = b * inverse[:, :, None]
        reduced = c - weighted.transpose(0, 2, 1) @ b
        scale = np.diagonal(c, axis1=1, axis2=2)
        scale = np.where(scale > 0, 1 / np.sqrt(np.where(scale > 0, scale, 1)), 0)
        value, vector = np.linalg.eigh(reduced * scale[:, :, None] * scale[:, None, :])
        kept = value > _RANK
        rhs = scale * (m - np.einsum("rlq,rl->rq", weighted, md))
        gamma = scale * np.einsum("rij,rj->ri", vector, np.einsum("rij,ri->rj", vector, rhs) * np.where(kept, 1 / np.where(kept, value, 1), 0))
        alpha = inverse * md - np.einsum("rlq,rq->rl", weighted, gamma)

        def terms(alpha: np.ndarray, gamma: np.ndarray, lane: np.ndarray) -> np.ndarray:
            """Level effects and the other coefficients as terms: the intercept is the reference level's effect."""
            out = np.zeros((len(gamma), self.terms))
            out[:, others] = gamma
            base = alpha[:, own == -1].sum(-1)
            out[:, own[own > 0]] = np.where(d[lane][:, own > 0] > 0, alpha[:, own > 0] - base[:, None], 0)
            out[:, 0] = base
            return out

        every = np.arange(len(d))
        beta = terms(alpha, gamma, every)
        # what the data leave open: directions of the reduced system, and the intercept where the reference level has no weight
        no_reference = d[:, own == -1].sum(-1) <= 0
        solid = np.where(scale[:, :, None] > 0, np.abs(vector), 0).max(1, initial=0) > 1e-6  # not only terms without any weight
        loose = np.flatnonzero((~kept & solid).any(-1) | no_reference)
        weight = self.own_squares({k: v[loose] for k, v in sums.items()}) if len(loose) else None
        for i, r in enumerate(loose):
            lane = np.array([r])
            u = (scale[r][:, None] * vector[r])[:, ~kept[r] & solid[r]].T
            free = [terms(-(weighted[r] @ v)[None], v[None], lane)[0] for v in u]
            if no_reference[r]:
                flat = np.zeros(self.terms)
                flat[0] = 1
                flat[own[(own > 0) & (d[r] > 0)]] = -1
                free.append(flat)
            basis = np.array(free) * np.sqrt(weight[i])
            basis /= np.maximum(np.linalg.norm(basis, axis=1, keepdims=True), 1e-300)
            left, singular, right = np.linalg.svd(basis, full_matrices=False)
            right = right[singular > 1e-6]
            root = np.sqrt(weight[i])
            scaled = beta[r] * root
            scaled -= right.T @ (right @ scaled)
            beta[r] = np.where(root > 0, scaled / np.where(root > 0, root, 1), 0)
        return beta

    def logistic(self, n: np.ndarray, successes: np.ndarray, start: np.ndarray | None = None, cap: float = 15.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """Maximum likelihood (trials and successes per lane and cell) by Newton steps, halved while they don't help. No numeric features.

        Separated cells have no finite optimum: a lane stops when a fitted value reaches +-cap, and is not converged.
        """

        def objective(eta: np.ndarray, at: np.ndarray) -> np.ndarray:
            return (successes[at] * eta - n[at] * np.logaddexp(0, eta)).sum(-1)

        beta = np.zeros((len(n), self.terms)) if start is None else np.repeat(start[None], len(n), axis=0)
        eta, converged, active = self.fitted(beta), np.zeros(len(n), bool), np.arange(len(n))
        value = objective(eta, active)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(eta[active], -cap, cap)))
            w = n[active] * p
            step = self.least_squares({"n": w * (1 - p), "s": successes[active] - w})
            direction, size = self.fitted(step), np.ones(len(active))
            for _ in range(21):
                new = objective(eta[active] + size[:, None] * direction, active)
                worse = new < value[active]
                if not worse.any():
                    break
                size = np.where(worse, size / 2, size)
            beta[active] += size[:, None] * step
            eta[active] += size[:, None] * direction
            reached = np.where(n[active] > 0, np.abs(eta[active]), 0).max(-1, initial=0) >= cap
            still = np.abs(new - value[active]) < 1e-10 * (np.abs(value[active]) + 1)
            value[active] = new
            converged[active[still & ~reached]] = True
            active = active[~still & ~reached]
            if not len(active):
                break
        return beta, converged
