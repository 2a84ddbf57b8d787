"""The sequential part of detection: training sets that depend on scores, drift, and retraining. One series and one
approach run in order, over rows that Spark has sorted; many of them run side by side."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.operators.models import Autoencoder


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.sort(a), np.sort(b)
    x = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, x, side="right") / len(a) - np.searchsorted(b, x, side="right") / len(b)).max())


def uniform_p_value(c: np.ndarray) -> tuple[float, float]:
    """The one-sample two-sided Kolmogorov-Smirnov statistic of c against the uniform distribution, and its p-value by
    the matrix method of Marsaglia, Tsang and Wang, or the limiting series for many values."""
    c = np.sort(c)
    n = len(c)
    i = np.arange(1, n + 1)
    d = float(np.maximum(i / n - c, c - (i - 1) / n).max())
    if n > 250:
        z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        return d, float(min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101)))))
    return d, _uniform_tail(n, d)


@functools.lru_cache(1 << 14)
def _uniform_tail(n: int, d: float) -> float:
    """The p-value of d by the matrix method; shares of a training set give the same few d again and again."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    behind = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    a = (behind >= 0).astype(float)
    powers = np.asarray([h ** (i + 1) for i in range(m)])
    a[:, 0] -= powers
    a[m - 1] -= powers[::-1]
    a[m - 1, 0] += max(2 * h - 1, 0) ** m
    shares = np.asarray([1.0, *[math.exp(-math.lgamma(i + 1)) for i in range(1, m + 1)]])
    a *= shares[np.maximum(behind, 0)]
    q = np.linalg.matrix_power(a, n)[k - 1, k - 1]
    return float(min(1.0, max(0.0, 1 - q * math.exp(math.lgamma(n + 1) - n * math.log(n)))))


@dataclass
class Settings:
    length: int = 10  # rows of a vector
    training: int = 200  # vectors of the training set
    step: int = 50  # rows of a tick
    score_rows: int = 50
    check_every: int = 5  # notifications between drift checks
    update: str = "sliding"  # sliding, uniform, aware
    drift: str = "ks"  # ks, musigma
    score: str = "likelihood"  # likelihood, average, confidence
    alpha: float = 0.05
    epochs: int = 5
    seed: int = 7


def kept_by_priority(old: np.ndarray, new: np.ndarray) -> tuple[list[int], list[int]]:
    """Old slots that go and new items that come: each new item in turn against the old ones from the least priority
    up, moving on when it is admitted."""
    order, j, gone, come = np.argsort(old, kind="stable"), 0, [], []
    for i, p in enumerate(new):
        if j < len(order) and p > old[order[j]]:
            gone.append(int(order[j]))
            come.append(i)
            j += 1
    return gone, come


def phi(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


@dataclass
class Approach:
    """State of one approach on one series: feed ticks of rows to step()."""

    s: Settings
    history: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows of the last vector
    t: int = 0

    def start(self, x: np.ndarray) -> None:
        """x: the warm-up rows, of which the last vectors are the first training set."""
        s = self.s
        self.rng = np.random.default_rng(s.seed)
        w = np.lib.stride_tricks.sliding_window_view(x, s.length)[-s.training :].copy()
        self.scale = (w.mean(), w.std() or 1.0)
        self.train, self.nc_train = w, np.zeros(len(w))
        self.model = Autoencoder(s.length, s.seed)
        self.model.fit(self._scaled(w), s.epochs)
        self.nc_train = self._nonconformity(w)
        self.recent = self.nc_train[-s.score_rows :].copy()
        self.priority = self._priority(self.rng.random(len(w)))
        self.reference, self.notes, self.version = w.copy(), 0, 0
        self.history, self.t = x[-(s.length - 1) :].copy(), len(x)
        self.conf: list[float] = []
        self.logs: list[float] = []
        self.top = 1.0

    def _scaled(self, w: np.ndarray) -> np.ndarray:
        return (w - self.scale[0]) / self.scale[1]

    def _nonconformity(self, w: np.ndarray) -> np.ndarray:
        x = self._scaled(w)
        p = self.model.predict(x)
        norm = np.linalg.norm(x, axis=1) * np.linalg.norm(p, axis=1)
        return 1 - np.where(norm > 0, (x * p).sum(1) / np.maximum(norm, 1e-12), 0.0)

    def _priority(self, score: np.ndarray) -> np.ndarray:
        return self.rng.uniform(0.7, 0.9, len(score)) ** (3 / np.exp(-3 * np.nan_to_num(score)))

    def _confidence(self, c: float) -> float | None:
        """Low p-values of the last confidences being uniform, on a moving scale from 0 to 1; none while warming up."""
        self.conf.append(c)
        if len(self.conf) <= 5 * self.s.score_rows:
            return None
        self.conf.pop(0)
        distinct = sorted(set(self.conf))
        if len(distinct) <= 30:
            return None
        self.logs = [*self.logs, -math.log(min(1.0, max(1e-40, uniform_p_value(np.asarray(distinct))[1])))][-max(1, len(self.conf) // 10) :]
        if max(self.logs) > 0.9 * self.top:
            self.top = max(self.logs) + 5
        low = min(self.logs)
        return (self.logs[-1] - low) / min(1e6, max(1e-6, max(self.top, max(self.logs)) - low))

    def step(self, x: np.ndarray) -> list[tuple]:
        """(t, nonconformity, score, version, drifted) of each row, scored by the model as it was before."""
        s = self.s
        rows = np.concatenate([self.history, x])
        w = np.lib.stride_tricks.sliding_window_view(rows, s.length)
        nc = self._nonconformity(w)
        scores: list[float | None] = []
        if s.score == "confidence":  # the training set stands for the whole tick
            scores = [self._confidence(c) for c in ((self.nc_train >= nc[:, None]).sum(1) / s.training).tolist()]
        for v in nc if s.score != "confidence" else ():
            self.recent = np.append(self.recent[1:], v)
            if s.score == "average":
                scores.append(float(self.recent.mean()))
            else:
                sd = max(float(self.recent.std(ddof=1)), 0.5)
                scores.append(phi((self.recent[-max(1, s.score_rows // 5) :].mean() - self.recent.mean()) / sd))
        version = self.version
        known = np.asarray([np.nan if a is None else a for a in scores], float)
        # a score-aware set takes no row without a score
        drifted = self._learn(w, nc, known) if s.update != "aware" else self._learn(w[~np.isnan(known)], nc[~np.isnan(known)], known[~np.isnan(known)])
        out = [(self.t + i, float(nc[i]), scores[i], version, drifted and i == len(x) - 1) for i in range(len(x))]
        self.history, self.t = rows[-(s.length - 1) :].copy(), self.t + len(x)
        return out

    def _learn(self, w: np.ndarray, nc: np.ndarray, scores: np.ndarray) -> bool:
        s = self.s
        if s.update == "sliding":
            keep, come = np.arange(len(self.train))[len(w) :], np.arange(len(w))[-s.training :]
        elif s.update == "uniform":
            if self.rng.random() >= s.training / (self.t + len(w)):
                return False
            gone = self.rng.choice(len(self.train), min(len(w), len(self.train)), replace=False)
            keep, come = np.setdiff1d(np.arange(len(self.train)), gone), np.arange(len(w))[: len(gone)]
        else:
            p = self._priority(scores)
            gone, come = kept_by_priority(self.priority, p)
            if not come:
                return False
            keep = np.setdiff1d(np.arange(len(self.train)), gone)
            self.priority = np.concatenate([self.priority[keep], p[come]])
        self.train = np.concatenate([self.train[keep], w[come]])
        self.nc_train = np.concatenate([self.nc_train[keep], nc[come]])
        self.notes += 1
        if self.notes % s.check_every or not self._drifted():
            return False
        self.model.fit(self._scaled(self.train), s.epochs)
        self.version += 1
        self.reference = self.train.copy()
        return True

    def _drifted(self) -> bool:
        if self.s.drift == "ks":
            return ks_statistic(self.train.ravel(), self.reference.ravel()) > math.sqrt(2 / len(self.train) * math.log(2 / self.s.alpha))
        clip = lambda v: np.clip(v, 1e-6, 1e20)
        sd0, sd = (math.sqrt(clip(v).sum()) for v in (self.reference.var(0), self.train.var(0, ddof=1)))
        return float(np.linalg.norm(self.train.mean(0) - self.reference.mean(0))) > sd0 or sd < sd0 / 2 or sd > 2 * sd0


ONLINE = "series_id string, t long, nonconformity double, score double, version int, drifted boolean"


def detect(series: DataFrame, settings: Settings, warm_up: int = 300) -> DataFrame:
    """The scores of each series (series_id, t, value) after its warm-up rows, by one approach.

    Spark sorts each partition by series and row, spilling where it must; a task reads it batch by batch and holds the
    approach's state and the rows of a tick, or of the warm-up, however long a series is. A null series_id is one series.
    """
    columns = ["series_id", "t", "nonconformity", "score", "version", "drifted"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, approach, x = None, None, np.zeros(0)

        def ticks(last: bool) -> pd.DataFrame:
            nonlocal approach, x
            if approach is None and len(x) > warm_up:
                approach = Approach(settings)
                approach.start(x[:warm_up])
                x = x[warm_up:]
            rows: list[tuple] = []
            while approach is not None and len(x) and (last or len(x) >= settings.step):
                rows += approach.step(x[: settings.step])
                x = x[settings.step :]
            return pd.DataFrame([(name, *r) for r in rows], columns=columns).astype({"score": "float64"})

        for pdf in batches:
            for key, part in pdf.groupby("series_id", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if key != name:
                    yield ticks(True)
                    name, approach, x = key, None, np.zeros(0)
                x = np.concatenate([x, part["value"].to_numpy(float)])
                yield ticks(False)
        yield ticks(True)

    ordered = series.select("series_id", "t", "value").repartition("series_id").sortWithinPartitions("series_id", "t")
    return ordered.mapInPandas(run, ONLINE)
