"""Estimators that the rolling backtest can train.

An estimator has a ``grid`` of parameters (dicts, in order of preference at equal scores) and two functions that run inside
tasks on NumPy arrays:

``fit(x, y, weight, params, seed) -> model``   ``x`` is (rows, features), all finite, scaled to [0, 1] on the training rows;
    ``weight`` is how often a row counts; rows come in a fixed order, so equal input gives equal models.
``predict(model, x) -> array``

Models travel between tasks pickled, so they should be small (arrays and numbers).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np


class Estimator(Protocol):
    grid: Sequence[dict]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: dict, seed: int): ...

    def predict(self, model, x: np.ndarray) -> np.ndarray: ...


def ridge_weights(xtx: np.ndarray, xty: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients from cross products whose first row is the free intercept."""
    penalty = np.eye(len(xtx)) * alpha
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(xtx + penalty, xty, rcond=None)[0]


@dataclass
class Ridge:
    """Linear regression with a squared penalty and a free intercept; the model is its coefficients."""

    alphas: Sequence[float] = (1e-5, 1e-2, 1.0)
    grid: Sequence[dict] = field(init=False)

    def __post_init__(self):
        self.grid = [{"alpha": a} for a in self.alphas]

    def fit(self, x, y, weight, params, seed):
        design = np.hstack([np.ones((len(x), 1)), x])
        weighed = design * weight[:, None]
        return ridge_weights(weighed.T @ design, weighed.T @ y, params["alpha"])

    def predict(self, model, x):
        return model[0] + x @ model[1:]


@dataclass
class BinnedMeans:
    """Each feature is cut into equal bins of [0, 1]; a prediction is the mean over the features of the mean target of
    the row's bin (of all rows, if the bin was empty in training)."""

    bins: Sequence[int] = (4, 16)
    grid: Sequence[dict] = field(init=False)

    def __post_init__(self):
        self.grid = [{"bins": b} for b in self.bins]

    @staticmethod
    def _bin(x, bins):
        return np.clip(np.floor(x * bins).astype(np.int64), 0, bins - 1)

    def fit(self, x, y, weight, params, seed):
        bins, (_, p) = params["bins"], x.shape
        mean = float(weight @ y / weight.sum())
        at = (self._bin(x, bins) + np.arange(p) * bins).ravel()
        n = np.bincount(at, np.repeat(weight, p), p * bins)
        total = np.bincount(at, np.repeat(weight * y, p), p * bins)
        return np.where(n > 0, total / np.where(n > 0, n, 1), mean).reshape(p, bins)

    def predict(self, model, x):
        p, bins = model.shape
        return model[np.arange(p), self._bin(x, bins)].mean(axis=1)


@dataclass
class Mlp:
    """A network of rectified layers, trained by Adam on squared error in shuffled batches, that stops when the training
    loss hasn't improved for ``patience`` epochs."""

    hidden: Sequence[tuple[int, ...]] = ((32, 16), (16, 8, 4))
    alphas: Sequence[float] = (1e-5,)
    rate: float = 0.001
    epochs: int = 1000
    batch: int = 32
    patience: int = 10
    grid: Sequence[dict] = field(init=False)

    def __post_init__(self):
        self.grid = [{"hidden": tuple(h), "alpha": a} for h in self.hidden for a in self.alphas]

    @staticmethod
    def start(sizes: Sequence[int], rnd: np.random.Generator) -> list[np.ndarray]:
        """Uniform weights and biases within 1 / sqrt(inputs): w1, b1, w2, b2, …"""
        out = []
        for n, m in zip(sizes[:-1], sizes[1:]):
            out += [rnd.uniform(-1, 1, (n, m)) / np.sqrt(n), rnd.uniform(-1, 1, m) / np.sqrt(n)]
        return out

    @staticmethod
    def forward(model: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        """The input and the output of each layer."""
        out = [x]
        for k in range(0, len(model), 2):
            z = out[-1] @ model[k] + model[k + 1]
            out.append(np.maximum(z, 0) if k + 2 < len(model) else z)
        return out

    @classmethod
    def gradients(cls, model: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean squared error and its derivatives by every weight and bias."""
        layers = cls.forward(model, x)
        off = layers[-1][:, 0] - y
        flow, out = (2 / len(y)) * off[:, None], []
        for k in range(len(model) - 2, -1, -2):
            below = layers[k // 2]
            out[:0] = [below.T @ flow, flow.sum(axis=0)]
            if k:
                flow = (flow @ model[k].T) * (below > 0)
        return float(off @ off / len(y)), out

    def fit(self, x, y, weight, params, seed):
        rnd = np.random.default_rng(seed)
        start = self.start([x.shape[1], *params["hidden"], 1], rnd)
        flat = np.concatenate([w.ravel() for w in start])  # all parameters, so that a step of Adam is a few calls whatever the layers
        grad, first, second, move, scale = (np.zeros_like(flat) for _ in range(5))
        model, slopes, at = [], [], 0
        for w in start:
            model.append(flat[at : at + w.size].reshape(w.shape))
            slopes.append(grad[at : at + w.size].reshape(w.shape))
            at += w.size
        last = len(model) - 2
        times = np.repeat(np.arange(len(x)), weight.astype(np.int64))
        best, waited, step = np.inf, 0, 0
        for _ in range(self.epochs):
            losses = []
            order = rnd.permutation(times)
            for block in range(0, len(order), self.batch * 128):
                rows = order[block : block + self.batch * 128]
                drawn, wanted = x[rows], y[rows]
                for at in range(0, len(rows), self.batch):
                    out, ys = [drawn[at : at + self.batch]], wanted[at : at + self.batch]
                    for k in range(0, last + 1, 2):
                        z = out[-1] @ model[k]
                        z += model[k + 1]
                        out.append(np.maximum(z, 0, out=z) if k < last else z)
                    off = out[-1][:, 0] - ys
                    losses.append(float(off @ off / len(ys)))
                    flow = (2 / len(ys)) * off[:, None]
                    for k in range(last, -1, -2):
                        below = out[k // 2]
                        np.matmul(below.T, flow, out=slopes[k])
                        np.add.reduce(flow, axis=0, out=slopes[k + 1])
                        if k:
                            flow = flow @ model[k].T
                            flow *= below > 0
                    step += 1
                    np.multiply(flat, params["alpha"], out=move)
                    np.add(grad, move, out=grad)
                    np.subtract(grad, first, out=move)
                    move *= 0.1
                    first += move
                    np.multiply(grad, grad, out=grad)
                    grad -= second
                    grad *= 0.001
                    second += grad
                    np.divide(first, 1 - 0.9**step, out=move)
                    move *= self.rate
                    np.divide(second, 1 - 0.999**step, out=scale)
                    np.sqrt(scale, out=scale)
                    scale += 1e-8
                    move /= scale
                    flat -= move
            loss = float(np.mean(losses))
            best, waited = (loss, 0) if loss < best else (best, waited + 1)
            if waited >= self.patience:
                break
        return [w.copy() for w in model]

    def predict(self, model, x):
        return self.forward(model, x)[-1][:, 0]
