"""A small dense network and a quasi-Newton minimiser, in NumPy."""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence

import numpy as np


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by a rational approximation with an absolute error below 2e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x * Phi(x) and its derivative."""
    phi = 0.5 * (1 + erf(x / np.sqrt(2)))
    return x * phi, phi + x * np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi)


class MLP:
    """Two GELU layers and a linear output; all weights are one vector."""

    def __init__(self, dims: int, hidden: int, vector: np.ndarray):
        self.shapes = [(dims, hidden), (hidden,), (hidden, hidden), (hidden,), (hidden, 1), (1,)]
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        self.weights = [part.reshape(s) for part, s in zip(np.split(vector, ends[:-1]), self.shapes, strict=True)]

    @staticmethod
    def initial(dims: int, hidden: int, seed: int) -> np.ndarray:
        """Uniform weights within +-1/sqrt(inputs)."""
        rng = np.random.default_rng(seed)
        layer = lambda i, o: rng.uniform(-1, 1, i * o + o) / np.sqrt(i)
        return np.concatenate([layer(dims, hidden), layer(hidden, hidden), layer(hidden, 1)])

    def forward(self, e: np.ndarray) -> tuple[np.ndarray, tuple]:
        w1, c1, w2, c2, w3, c3 = self.weights
        h1, d1 = gelu(e @ w1 + c1)
        h2, d2 = gelu(h1 @ w2 + c2)
        return (h2 @ w3 + c3)[:, 0], (e, h1, d1, h2, d2)

    def backward(self, tape: tuple, slope: np.ndarray) -> np.ndarray:
        """The gradient of sum(slope * output) in all weights."""
        e, h1, d1, h2, d2 = tape
        g3 = slope[:, None]
        g2 = (g3 @ self.weights[4].T) * d2
        g1 = (g2 @ self.weights[2].T) * d1
        parts = [e.T @ g1, g1.sum(0), h1.T @ g2, g2.sum(0), h2.T @ g3, g3.sum(0)]
        return np.concatenate([p.ravel() for p in parts])


Evaluated = tuple[float, np.ndarray]


def descent(start: np.ndarray, max_iter: int, memory: int = 10, tol: float = 1e-6) -> Generator[np.ndarray, Evaluated, tuple[np.ndarray, list[float]]]:
    """L-BFGS with a backtracking line search: yields points, wants their value and gradient, and returns the best point and the
    objective after each step. So several descents can share the jobs that evaluate their points."""
    x, (value, gradient) = start, (yield start)
    history, pairs = [value], []
    for _ in range(max_iter):
        d, used = -gradient, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            used.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, size = float(gradient @ d), 1.0
        for _ in range(12):
            trial = x + size * d
            new_value, new_gradient = yield trial
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = trial - x, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value < tol * (abs(value) + 1)
        x, value, gradient = trial, new_value, new_gradient
        history.append(value)
        if done:
            break
    return x, history


def minimise_together(evaluate: Callable[[dict[int, np.ndarray]], dict[int, Evaluated]], starts: Sequence[np.ndarray], max_iter: int, **options) -> list[tuple[np.ndarray, list[float]]]:
    """Runs a descent from each start. `evaluate` gets the points of all that still run, by their number, at once."""
    runs = [descent(s, max_iter, **options) for s in starts]
    points, out = {i: next(run) for i, run in enumerate(runs)}, [None] * len(runs)
    while points:
        found, following = evaluate(points), {}
        for i in points:
            try:
                following[i] = runs[i].send(found[i])
            except StopIteration as end:
                out[i] = end.value
        points = following
    return out


def minimise(objective: Callable[[np.ndarray], Evaluated], start: np.ndarray, max_iter: int, **options) -> tuple[np.ndarray, list[float]]:
    """A single descent."""
    return minimise_together(lambda points: {i: objective(x) for i, x in points.items()}, [start], max_iter, **options)[0]
