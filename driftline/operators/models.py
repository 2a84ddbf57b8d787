"""Predictors, each a small numpy fit and prediction that Spark runs by series."""

from __future__ import annotations

import numpy as np


class Var:
    """Vector autoregression by least squares; lag by the Akaike criterion, over the same rows for all lags that the
    rows suffice for. x: rows by channels."""

    def __init__(self, x: np.ndarray, max_lag: int = 50):
        best = None
        most = min(max_lag, (len(x) - 2) // (x.shape[1] + 1))
        for lag in range(1, most + 1):
            a, y = self._design(x[most - lag :], lag), x[most:]
            coef = np.linalg.lstsq(a, y, rcond=None)[0]
            cov = (y - a @ coef).T @ (y - a @ coef) / len(y)
            aic = np.linalg.slogdet(cov + 1e-12 * np.eye(len(cov)))[1] + 2 * coef.size / len(y)
            if best is None or aic < best[0]:
                best = (aic, lag)
        if best is None:
            raise ValueError("too few rows for a lag")
        self.lag = best[1]
        self.coef = np.linalg.lstsq(self._design(x, self.lag), x[self.lag :], rcond=None)[0]

    @staticmethod
    def _design(x: np.ndarray, lag: int) -> np.ndarray:
        return np.column_stack([np.ones(len(x) - lag), *[x[lag - j : len(x) - j] for j in range(1, lag + 1)]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One-step forecasts of rows lag.. of x."""
        return self._design(x, self.lag) @ self.coef


class Forest:
    """Extended isolation forest: trees split by random hyperplanes; score 2 ** (-mean depth / normaliser)."""

    def __init__(self, x: np.ndarray, trees: int, sample: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(x)))
        self.limit = int(np.ceil(np.log2(self.sample)))
        self.trees = [self._tree(x) for _ in range(trees)]
        self.counters = np.zeros(trees, int)

    def _tree(self, x: np.ndarray):
        return self._split(x[self.rng.permutation(len(x))[: self.sample]], 0)

    def _split(self, x: np.ndarray, depth: int):
        if depth >= self.limit or len(x) <= 1 or (x == x[0]).all():
            return self.average(len(x))
        n, p = self.rng.standard_normal(x.shape[1]), self.rng.uniform(x.min(0), x.max(0))
        left = (x - p) @ n <= 0
        return n, p, self._split(x[left], depth + 1), self._split(x[~left], depth + 1)

    @staticmethod
    def average(n: int) -> float:
        """Mean depth of an unsuccessful search among n."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _depth(self, node, x: np.ndarray, out: np.ndarray, at: np.ndarray, depth: int) -> None:
        if not isinstance(node, tuple):
            out[at] = depth + node
            return
        n, p, a, b = node
        left = (x[at] - p) @ n <= 0
        self._depth(a, x, out, at[left], depth + 1)
        self._depth(b, x, out, at[~left], depth + 1)

    def depths(self, x: np.ndarray) -> np.ndarray:
        """trees by rows."""
        out = np.zeros((len(self.trees), len(x)))
        for tree, row in zip(self.trees, out, strict=True):
            self._depth(tree, x, row, np.arange(len(x)), 0)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 2 ** (-self.depths(x).mean(0) / max(self.average(self.sample), 1e-9))

    def vote(self, x: np.ndarray, threshold: float) -> None:
        """One up for trees whose verdict is the ensemble's, one down for the others, for each row."""
        each = 2 ** (-self.depths(x) / max(self.average(self.sample), 1e-9)) > threshold
        self.counters += np.where(each == (self.scores(x) > threshold)[None, :], 1, -1).sum(1)

    def renew(self, x: np.ndarray) -> int:
        """Rebuilds the trees with a negative counter and clears all counters."""
        old = np.nonzero(self.counters < 0)[0]
        for i in old:
            self.trees[i] = self._tree(x)
        self.counters[:] = 0
        return len(old)


class Net:
    """Dense layers trained by Adam on squared error."""

    def __init__(self, sizes: list[int], seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.m = [np.zeros_like(p) for p in self.w + self.b]
        self.v = [np.zeros_like(p) for p in self.w + self.b]
        self.t = 0

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            out.append(np.maximum(x, 0) if i < len(self.w) - 1 else x)
        return out

    def grads(self, acts: list[np.ndarray], d: np.ndarray):
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.insert(0, acts[i].T @ d)
            gb.insert(0, d.sum(0))
            d = d @ self.w[i].T
            if i:
                d = d * (acts[i] > 0)
        return gw + gb, d

    def update(self, g: list[np.ndarray], rate: float = 1e-3) -> None:
        self.t += 1
        for p, gi, m, v in zip(self.w + self.b, g, self.m, self.v, strict=True):
            m += 0.1 * (gi - m)
            v += 0.001 * (gi * gi - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Usad:
    """Two decoders on one encoder: both reconstruct, and the second learns to tell the first's output from the input.
    The weight of plain reconstruction falls as 1 / epoch down to `plain`; at 1, the default, only reconstruction counts.
    Below that the second decoder, whose outputs are not bounded, can run away. predict gives the output with the least last loss."""

    def __init__(self, length: int, latent: int, seed: int, plain: float = 1.0):
        self.plain = plain
        a, b = max(2, length // 2), max(2, length // 4)
        self.enc, self.d1, self.d2 = Net([length, a, b, latent], seed), Net([latent, b, a, length], seed + 1), Net([latent, b, a, length], seed + 2)
        self.epoch, self.best = 0, 0

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        one = self.d1.forward(self.enc.forward(x)[-1])[-1]
        two = self.d2.forward(self.enc.forward(x)[-1])[-1]
        return [one, two, self.d2.forward(self.enc.forward(one)[-1])[-1]]

    def fit(self, x: np.ndarray, epochs: int, batch: int = 32) -> None:
        rng = np.random.default_rng(self.epoch)
        for _ in range(epochs):
            self.epoch += 1
            e = max(1 / self.epoch, self.plain)
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                y = x[at]
                z = self.enc.forward(y)
                one, two = self.d1.forward(z[-1]), self.d2.forward(z[-1])
                z3 = self.enc.forward(one[-1])
                three = self.d2.forward(z3[-1])
                n = y.size / 2
                # first decoder: e * |x - d1|^2 + (1 - e) * |x - d2(d1)|^2; second: e * |x - d2|^2 - (1 - e) * |x - d2(d1)|^2
                g3, back = self.d2.grads(three, (1 - e) * (three[-1] - y) / n)
                ge3, dx = self.enc.grads(z3, back)
                g1, dz1 = self.d1.grads(one, e * (one[-1] - y) / n + dx)
                g2, dz2 = self.d2.grads(two, e * (two[-1] - y) / n)
                ge, _ = self.enc.grads(z, dz1 + dz2)
                self.d1.update(g1)
                self.d2.update([a - b for a, b in zip(g2, g3, strict=True)])
                self.enc.update([a + b for a, b in zip(ge, ge3, strict=True)])
        self.best = int(np.argmin([((o - x) ** 2).mean() for o in self.outputs(x)]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.outputs(x)[self.best]


class Autoencoder:
    """One hidden layer of 20."""

    def __init__(self, length: int, seed: int):
        self.net = Net([length, 20, length], seed)

    def fit(self, x: np.ndarray, epochs: int, batch: int = 32) -> None:
        rng = np.random.default_rng(self.net.t)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                acts = self.net.forward(x[at])
                self.net.update(self.net.grads(acts, 2 * (acts[-1] - x[at]) / x[at].size)[0])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.net.forward(x)[-1]


def fit_gamma(x: np.ndarray, d: int, taps: int) -> np.ndarray:
    """Weights of the d-th differences of the last `taps` rows that least squares adds to the difference forecast."""
    diff = np.diff(x, d) if d else x
    rows = len(diff) - taps
    a = np.column_stack([diff[taps - 1 - i : taps - 1 - i + rows] for i in range(taps)])
    return np.linalg.lstsq(a, diff[taps : taps + rows], rcond=None)[0]
