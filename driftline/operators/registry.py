"""Models as rows: fitted on a bounded part of each series, stored with the row from which they hold, and met again by
the chunks of rows they score, so that no task holds a long series."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import models

#: Rows of a chunk: a model travels once with each.
CHUNK = 1 << 16
SCHEMA = "series_id string, approach string, version int, from_t long, weights binary"


class Predictor(Protocol):
    """What a model of windows offers: it learns from windows and gives each back as it should look."""

    def fit(self, w: np.ndarray, epochs: int) -> None: ...

    def predict(self, w: np.ndarray) -> np.ndarray: ...


MAKERS: dict[str, Callable[[int], Predictor]] = {"autoencoder": lambda n: models.Autoencoder(n, 7), "usad": lambda n: models.Usad(n, max(1, n // 10), 7)}


def _windows(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("t")
    x = pdf["value"].to_numpy(float)
    if len(x) < length:
        return np.zeros(0, np.int64), np.zeros((0, length))
    return pdf["t"].to_numpy()[length - 1 :], np.lib.stride_tricks.sliding_window_view(x, length)


def fit_first(series: DataFrame, rows: int, fit: Callable[[np.ndarray], object], least: int = 1, value: str = "value") -> DataFrame:
    """(series_id, weights): what fit makes of the values of the first `rows` rows of each series; none for series of
    fewer than `least` rows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.asarray(pdf.sort_values("t")[value].tolist(), float)
        return pd.DataFrame([(key[0], pickle.dumps(fit(x)))] if len(x) >= least else [], columns=["series_id", "weights"], dtype=object)

    return series.where(F.col("t") < rows).select("series_id", "t", value).groupBy("series_id").applyInPandas(run, "series_id string, weights binary")


def in_chunks(series: DataFrame, fitted: DataFrame, before: int, run: Callable[[pd.DataFrame, pd.DataFrame], dict], schema: str, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """run's rows (with series_id and t) over chunks of each series, given a chunk's rows in order, with the `before` rows
    ahead of it, and the rows of `fitted` of its series. A series without models has no rows; a null series_id is one."""
    reach = F.sequence(F.floor(F.col("t") / chunk), F.floor((F.col("t") + before) / chunk))
    rows = series.select("series_id", "t", value, F.explode(reach).alias("_chunk"))
    ends = series.groupBy(F.col("series_id").alias("_id")).agg(F.floor(F.max("t") / chunk).alias("_last"))
    models_ = fitted.join(ends, F.col("series_id").eqNullSafe(F.col("_id"))).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_id", "_last")

    def scored(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(found):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)
        out = pd.DataFrame({"series_id": key[0], **run(pdf.sort_values("t"), found)})
        return out[out["t"] >= key[1] * chunk].astype({"series_id": object})

    return rows.groupBy("series_id", "_chunk").cogroup(models_.groupBy("series_id", "_chunk")).applyInPandas(scored, schema)


def predicted(series: DataFrame, fitted: DataFrame, before: int, predict: Callable[[np.ndarray, np.ndarray, object], dict], schema: str, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """predict's rows, given a chunk's t and values and what fit_first made of its series."""

    def run(pdf: pd.DataFrame, found: pd.DataFrame) -> dict:
        return predict(pdf["t"].to_numpy(), np.asarray(pdf[value].tolist(), float), pickle.loads(found["weights"].iloc[0]))

    return in_chunks(series, fitted, before, run, schema, value, chunk)


def cosine_distances(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By row; 1 where either is zero."""
    return 1 - (w * p).sum(1) / np.maximum(np.linalg.norm(w, axis=1) * np.linalg.norm(p, axis=1), 1e-12)


def fit_models(series: DataFrame, kind: str, versions: list[int], length: int = 20, training: int = 200, epochs: int = 5) -> DataFrame:
    """A model of each series for each row number in versions, fitted on the last `training` windows before it; a later
    version goes on from the weights of the one before. Only rows that a version learns from are read."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, w = _windows(pdf, length)
        out, model = [], MAKERS[kind](length)
        for v, at in enumerate(sorted(versions)):
            known = w[t < at][-training:]
            if len(known):
                mean, sd = known.mean(), known.std() or 1.0
                model.fit((known - mean) / sd, epochs)
                out.append((key[0], kind, v, at, pickle.dumps((mean, sd, model))))
        return pd.DataFrame(out, columns=["series_id", "approach", "version", "from_t", "weights"])

    known = series.where((F.col("t") < max(versions)) & (F.col("t") > min(versions) - training - length))
    return known.select("series_id", "t", "value").groupBy("series_id").applyInPandas(run, SCHEMA)


def score_with(series: DataFrame, fitted: DataFrame, length: int = 20, chunk: int = CHUNK) -> DataFrame:
    """(series_id, t, version, nc): the cosine distance of each window to what the model in force at its end says."""

    def run(pdf: pd.DataFrame, versions: pd.DataFrame) -> dict:
        t, w = _windows(pdf, length)
        versions = versions.sort_values("from_t")
        version, nc = np.full(len(t), -1), np.zeros(len(t))
        edges = [*versions["from_t"].tolist(), np.inf]
        for number, weights, since, until in zip(versions["version"], versions["weights"], edges, edges[1:], strict=False):
            at = (t >= since) & (t < until)
            if at.any():
                mean, sd, model = pickle.loads(weights)
                x = (w[at] - mean) / sd
                version[at], nc[at] = number, cosine_distances(x, model.predict(x))
        return {"t": t[version >= 0], "version": version[version >= 0], "nc": nc[version >= 0]}

    return in_chunks(series, fitted, length - 1, run, "series_id string, t long, version int, nc double", chunk=chunk)
