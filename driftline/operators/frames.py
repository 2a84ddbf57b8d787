"""Rolling frames over long series, feature vectors, forecasts by differences, and nonconformity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.functions.math import cosine_distance, difference_factors, euclidean, mean_abs_diff

CHUNK = 8192


Frames = dict[str, Callable[[WindowSpec], Column]]


def rolling(df: DataFrame, before: int, columns: Frames | list[Frames], after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """df with columns over row frames of at most `before` rows back and `after` rows ahead; in a list, later columns may
    use earlier ones, and `before` and `after` are what their frames reach together.

    A series is cut into chunks of `chunk` rows, and each chunk also gets the few rows around it that its frames reach
    into. So the tasks are as many as chunks, not as series, and no task holds a long series. t must have no gaps.
    """
    at = F.floor(F.col("t") / chunk)
    reach = F.sequence(F.greatest(F.floor((F.col("t") - after) / chunk), F.lit(0)), F.floor((F.col("t") + before) / chunk))
    w = Window.partitionBy("series_id", "_chunk").orderBy("t")
    df = df.withColumn("_chunk", F.explode(reach))
    for layer in columns if isinstance(columns, list) else [columns]:
        df = df.withColumns({k: f(w) for k, f in layer.items()})
    return df.where(F.col("_chunk") == at).drop("_chunk")


def feature_vectors(series: DataFrame, length: int, lag: int = 0, value: str = "value") -> DataFrame:
    """fv, the last `length` values in order, as of row t - lag; only full ones."""
    frame = lambda w: F.collect_list(value).over(w.rowsBetween(-(length - 1) - lag, -lag))
    return rolling(series, length - 1 + lag, {"fv": frame}).where(F.size("fv") == length)


def last_windows(vectors: DataFrame, n: int) -> DataFrame:
    """The training set of a sliding window: the last n feature vectors of each series."""
    last = vectors.groupBy("series_id").agg(F.max("t").alias("_last"))
    return vectors.join(last, "series_id").where(F.col("t") > F.col("_last") - n).drop("_last")


def difference_forecast(series: DataFrame, d: int) -> DataFrame:
    """pred: the sum of the differences of order 0 to d - 1 of the row before."""
    terms = difference_factors(d)
    pred = lambda w: sum((F.lag("value", k + 1).over(w) * F.lit(c) for k, c in enumerate(terms[1:], 1)), F.lag("value", 1).over(w) * F.lit(terms[0]))
    return rolling(series, d, {"pred": pred})


def online_forecast(series: DataFrame, taps: int, chunk: int = CHUNK, ridge: float = 1.0) -> DataFrame:
    """pred: the row before plus its last `taps` differences, each with a weight, from row taps + 1 on; weights: those in
    force in the row's chunk, by least squares (with a ridge) over all rows of the series before that chunk, 0 at first.

    The normal equations are sums of products, so each chunk gives its own, and a running sum over chunks, a row a chunk,
    gives what is known at the start of each; one small system a chunk is solved, wherever the chunk is. No task holds a
    series, and no row waits for those before it. t must have no gaps.
    """
    past = rolling(series, taps + 1, {"_past": lambda w: F.collect_list("value").over(w.rowsBetween(-taps - 1, 0))}).where(F.size("_past") == taps + 2)
    x = F.transform(F.sequence(F.lit(1), F.lit(taps)), lambda i: F.get("_past", taps + 1 - i) - F.get("_past", taps - i))
    rows = past.select("series_id", "t", F.get("_past", F.lit(taps)).alias("_before"), (F.col("value") - F.get("_past", F.lit(taps))).alias("_y"), x.alias("_x"), F.floor(F.col("t") / chunk).alias("_chunk"))
    cells = [(i, j) for i in range(taps) for j in range(i, taps)]
    sums = rows.groupBy("series_id", "_chunk").agg(*[F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"_a{i}_{j}") for i, j in cells], *[F.sum(F.col("_x")[i] * F.col("_y")).alias(f"_b{i}") for i in range(taps)])
    before = Window.partitionBy("series_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    cell = lambda i, j: so_far(f"_a{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    known = sums.select("series_id", "_chunk", F.flatten(F.array(*[F.array(*[cell(i, j) for j in range(taps)]) for i in range(taps)])).alias("_a"), F.array(*[so_far(f"_b{i}") for i in range(taps)]).alias("_b"))

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(np.linalg.solve(np.stack(a.to_list()).reshape(-1, taps, taps), np.stack(b.to_list())[:, :, None])[:, :, 0]) if len(a) else [])

    out = rows.join(known.select("series_id", "_chunk", solved("_a", "_b").alias("weights")), ["series_id", "_chunk"])
    return out.select("series_id", "t", "weights", (F.col("_before") + F.aggregate(F.zip_with("weights", "_x", lambda g, v: g * v), F.lit(0.0), lambda s, v: s + v)).alias("pred"))


#: Columns of nonconformity, whose frames reach one row back.
NC: Frames = {"nc": lambda w: F.coalesce(F.abs(F.col("value") - F.lag("value", 1).over(w)), F.lit(0.0))}


def nonconformity(series: DataFrame) -> DataFrame:
    """nc: the absolute difference to the row before, 0 for the first."""
    return rolling(series, 1, NC)


NC_SQL = "n AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY t)), 0.0::DOUBLE) AS nc FROM e)"


def batches(series: DataFrame, start: int, step: int) -> DataFrame:
    """batch_id: 0, 1, .. from row `start` on, -1 before."""
    return series.withColumn("batch_id", F.when(F.col("t") < start, -1).otherwise(F.floor((F.col("t") - start) / step)).cast("long"))


def running_max_normalised(series: DataFrame, start: int = 100, step: int = 50) -> DataFrame:
    """nc over the largest one of all batches so far, or 1 if that is more. Maxima run over batches, not over rows."""
    b = batches(series, start, step).where("batch_id >= 0")
    tops = b.groupBy("series_id", "batch_id").agg(F.max("nc").alias("top"))
    upto = Window.partitionBy("series_id").orderBy("batch_id")
    tops = tops.select("series_id", "batch_id", F.greatest(F.lit(1.0), F.max("top").over(upto)).alias("running_max"))
    return b.join(tops, ["series_id", "batch_id"]).withColumn("normalised", F.col("nc") / F.col("running_max"))


# vectors of several channels: fv is an array of rows, each an array of channels


def flat(fv: Column) -> Column:
    return F.flatten(fv)


def input_rows(fv: Column) -> Column:
    """What a forecaster reads: all rows but the last."""
    return F.slice(fv, 1, F.size(fv) - 1)


def target_row(fv: Column) -> Column:
    """What it predicts: the last row."""
    return F.element_at(fv, -1)


def first_row(fv: Column) -> Column:
    return F.element_at(fv, 1)


def by_channel(fv: Column) -> Column:
    """fv with channels outside and rows inside."""
    return F.transform(first_row(fv), lambda _, c: F.transform(fv, lambda r: F.get(r, c)))


def points(vectors: DataFrame) -> DataFrame:
    """The rows of all vectors as one bag of points: series_id, t (of the vector), i (the row in it), point."""
    return vectors.select("series_id", "t", F.posexplode("fv").alias("i", "point"))


def model_nonconformity(vectors: DataFrame, kind: str, measure: str, channels: int) -> DataFrame:
    """nc of vectors (fv and prediction, arrays of rows) by the kind of model: a reconstruction is measured as a whole, a
    forecast by its last row and, with one channel, always by the mean absolute difference; a forest's own score
    (in prediction, one number) passes."""
    if kind == "iforest":
        return vectors.withColumn("nc", F.col("prediction"))
    x, p = F.col("fv"), F.col("prediction")
    if kind == "forecasting":
        x, p = F.array(target_row(x)), F.array(target_row(p))
        measure = measure if channels > 1 else "mean_abs_diff"
    by = {"euclidean": euclidean, "mean_abs_diff": mean_abs_diff, "cosine_sim": cosine_distance}
    return vectors.withColumn("nc", by[measure](flat(x), flat(p)))


def over_own_maximum(nc: DataFrame) -> DataFrame:
    """The scores of a forecaster's first training set, over their maximum."""
    tops = nc.groupBy("series_id").agg(F.max("nc").alias("_top"))
    return nc.join(tops, "series_id").withColumn("nc", F.try_divide(F.col("nc"), F.col("_top"))).drop("_top")
