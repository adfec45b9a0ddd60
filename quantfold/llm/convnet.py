"""A small convolutional text network in numpy: symbol embeddings, filters of several widths, max
pooling over a text and a linear layer.  Training is plain Adam, over rows held together (``fit``) or
step by step (``step``); applying it needs only table lookups, because a filter over embedded symbols
is a sum of one table row per position."""

from __future__ import annotations

import numpy as np


class ConvNet:
    """``symbols`` embedding rows, ``outputs`` numbers per text; padding has a zero embedding."""

    def __init__(self, symbols: int, embed: int, widths: tuple[int, ...], filters: int, outputs: int, seed: int = 0):
        rnd = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.p = {"embed": rnd.normal(0, 0.3, (symbols, embed)), "out": rnd.normal(0, 0.1, (len(widths) * filters, outputs)), "bias": np.zeros(outputs)}
        self.p |= {f"w{w}": rnd.normal(0, (w * embed) ** -0.5, (w, embed, filters)) for w in widths}
        self.p |= {f"b{w}": np.zeros(filters) for w in widths}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @property
    def pad(self) -> int:
        """Padding symbols that must follow each text, so that no filter sees the next one."""
        return max(self.widths)

    def pooled(self, numbers: np.ndarray, starts: np.ndarray, rows: np.ndarray):
        """Largest response of every filter in each text, its first padding included, and what ``gradients`` needs.

        ``numbers``: the symbols, -1 for padding; ``rows[number]``: the embedding rows, one or more,
        that a symbol adds up."""
        used, code = np.unique(numbers, return_inverse=True)
        e = self.p["embed"][rows[used]].sum(1) * (used >= 0)[:, None]
        sizes = np.diff(np.append(starts, len(numbers))) - self.pad + 1
        inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        text_of = np.repeat(np.arange(len(starts)), sizes)
        values, where = [], []
        for w in self.widths:
            r = (e @ self.p[f"w{w}"][0] + self.p[f"b{w}"])[code]
            for j in range(1, w):
                r[:-j] += (e @ self.p[f"w{w}"][j])[code[j:]]
            r = r[inside]
            top = np.maximum.reduceat(r, np.cumsum(sizes) - sizes, axis=0)
            row, f = np.nonzero(r == top[text_of])
            at = np.empty(top.shape, np.int64)
            at[text_of[row[::-1]], f[::-1]] = inside[row[::-1]]  # the first of equal ones
            values.append(top)
            where.append(at)
        return np.maximum(np.concatenate(values, 1), 0), (rows[used], code, e, np.concatenate(where, 1))

    def gradients(self, dout, hidden, context) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """``dout``: gradient of the loss by the outputs; "embed" for the returned rows only."""
        rows, code, e, where = context
        g = {"out": hidden.T @ dout, "bias": dout.sum(0)}
        ge = np.zeros_like(e)
        dh = (dout @ self.p["out"].T) * (hidden > 0)
        for i, w in enumerate(self.widths):
            cols = slice(i * self.filters, (i + 1) * self.filters)
            d, at = dh[:, cols], where[:, cols]
            g[f"b{w}"] = d.sum(0)
            g[f"w{w}"] = np.empty_like(self.p[f"w{w}"])
            for j in range(w):
                c = code[at + j]
                g[f"w{w}"][j] = np.einsum("nf,nfe->ef", d, e[c])
                np.add.at(ge, c.ravel(), (d[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, e.shape[1]))
        touched = np.flatnonzero(ge[1:].any(1)) + 1  # number -1, the padding, sorts first
        on, back = np.unique(rows[touched], return_inverse=True)
        g["embed"] = np.zeros((len(on), e.shape[1]), np.float32)
        for c in back.reshape(len(touched), -1).T:
            np.add.at(g["embed"], c, ge[touched])
        return g, on

    def fit(self, texts: list[np.ndarray], symbols: np.ndarray, loss_gradient, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0, vary=None) -> None:
        """``symbols``: the ``rows`` of ``pooled``; ``loss_gradient(rows, outputs)``: gradient by the outputs; ``vary(symbols, rnd)``: augmentation."""
        rnd, step = np.random.default_rng(seed), 0
        moments = self.moments()
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rnd.permutation(len(texts))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                step += 1
                self.step(rows, [vary(texts[i], rnd) if vary else texts[i] for i in rows], symbols, loss_gradient, moments, step, rate * (1 - step / (total + 1)))

    def moments(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Adam's averages before the first step."""
        return {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}

    def step(self, rows: np.ndarray, texts: list[np.ndarray], symbols: np.ndarray, loss_gradient, moments, step: int, rate: float) -> None:
        """The ``step``-th step (from 1) of Adam, on ``texts``, the texts of ``rows``."""
        m, v2 = moments
        hidden, context = self.pooled(*self.laid(texts), symbols)
        g, used = self.gradients(loss_gradient(rows, hidden @ self.p["out"] + self.p["bias"]).astype(np.float32), hidden, context)
        now = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, x in g.items():
            on = used if k == "embed" else slice(None)
            m[k][on] += 0.1 * (x - m[k][on])
            v2[k][on] += 0.001 * (x * x - v2[k][on])
            self.p[k][on] -= now * m[k][on] / (np.sqrt(v2[k][on]) + 1e-8)

    def laid(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts one after another with their padding, and their starts."""
        pad = np.full(self.pad, -1, np.int64)
        lens = np.array([len(t) + self.pad for t in texts], np.int64)
        return np.concatenate([x for t in texts for x in (t, pad)]).astype(np.int64), np.cumsum(lens) - lens

    def outputs(self, texts: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        return self.pooled(*self.laid(texts), symbols)[0] @ self.p["out"] + self.p["bias"]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
