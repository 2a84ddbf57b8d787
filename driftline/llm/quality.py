"""A text-quality classifier by compression with labelled dictionaries."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import id_crc, table


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    block: int = 512
    level: int = 3

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        make = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        return make(self.good), make(self.bad)

    def difference(self, text: str, with_: tuple) -> float:
        """Bytes that the good dictionary saves over the bad one, for each byte of the whole text; 0 for an empty one.
        Blocks are compressed one by one, so that the dictionaries count all along a long text."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        good, bad = with_
        saved = 0
        for at in range(0, len(data), self.block):
            part = data[at : at + self.block]
            saved += len(bad.compress(part)) - len(good.compress(part))
        return saved / len(data)

    def score(self, difference: float) -> float:
        z = self.slope * difference + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _dictionary(texts: list[str], size: int, block: int) -> bytes:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    parts = [d[i : i + block] for d in data for i in range(0, len(d), block)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: the samples themselves
        return b"".join(parts)[:size] or b"\n" * 8


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, both classes weighing the same; Newton steps with a small ridge."""
    scale = max(float(np.abs(x).mean()), 1e-6)
    m = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (weight * p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), m.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 1000, max_bytes: int = 65_536, dictionary_bytes: int = 65_536, block: int = 512, level: int = 3) -> CompressionModel:
    """A model from a bounded sample of labelled rows: at most per_class of each label, chosen by hashes of the id, each
    text whole and of at most max_bytes. Half of each makes the dictionaries, the other half sets the curve, whose
    intercept then follows the labels' shares over all labelled training rows. Without both labels every score is the
    share of label 1. train: a condition on doc_id for the labels to learn from. Rows with a null id, a null or empty text,
    or another label are not learnt from; repeated labels count as often as they stand in the shares, and once in the
    sample; of repeated documents each may be in it. The choice goes by hashes, so a second fit is the same."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    labels = labels if train is None else labels.where(train)
    found = docs.where(F.octet_length("text").between(1, max_bytes)).select("doc_id", "text")
    counts = dict(labels.groupBy("quality").agg(F.count("*")).collect())
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    halves: list[list[tuple[str, int]]] = [[], []]
    for label in (0, 1):
        # a share of the ids, by a hash, that gives about twice as many as needed: some have no document here
        share = min(1.0, 2 * per_class / max(1, counts.get(label, 0)))
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= int(share * (1 << 40))
        some = labels.where((F.col("quality") == label) & chosen).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * per_class)
        rows = found.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(4 * per_class).collect()
        rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))[:per_class]
        for i, r in enumerate(rows):
            halves[i % 2].append((r["text"], label))
    make = lambda k: _dictionary([t for t, y in halves[0] if y == k], dictionary_bytes, block)
    model = CompressionModel(make(1), make(0), 0.0, prior, block, level)
    y = np.asarray([k for _, k in halves[1]])
    if len(set(y.tolist())) < 2:
        return model
    with_ = model.compressors()
    slope, intercept = _platt(np.asarray([model.difference(t, with_) for t, _ in halves[1]]), y)
    return CompressionModel(model.good, model.bad, slope, intercept + prior, block, level)


def score_texts(docs: DataFrame, model: CompressionModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Only the text is read. A null text is scored as an empty one, which the dictionaries don't tell apart. Columns of
    these names are replaced; no documents give no rows.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_ = model.compressors()
        for texts in batches:
            yield pd.Series([model.score(model.difference(t, with_)) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.coalesce(F.col(text), F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: Rows whose id has this remainder are never learnt from.
FOLDS, HELD = 4, 2


def held_out(key: Column) -> Column:
    return id_crc(key) % FOLDS == HELD


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
