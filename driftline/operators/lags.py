"""Vector autoregression from one matrix of cross products: all lags' criteria, the chosen one's weights and forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.frames import CHUNK, rolling


def standardised(series: DataFrame, channels: int) -> DataFrame:
    """values with each channel's mean taken away and over its deviation, of the whole series; constant channels are 0."""
    stats = series.groupBy("series_id").agg(*[f(F.col("values")[c]).alias(f"_{n}{c}") for c in range(channels) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = F.array(*[F.coalesce(F.try_divide(F.col("values")[c] - F.col(f"_m{c}"), F.col(f"_s{c}")), F.lit(0.0)) for c in range(channels)])
    return series.join(stats, "series_id").select("series_id", "t", z.alias("values"))


def lag_products(series: DataFrame, lags: int, chunk: int = CHUNK) -> DataFrame:
    """(series_id, at, total): the sums of products of a one, the channels of a row and those of the `lags` rows before,
    over all rows that have so many before them; at counts the cells of the square matrix row by row.

    Chunks of a series, each with the few rows before it, give a matrix each, and Spark adds those up cell by cell: a series
    of any length is many tasks, and what moves is a matrix a chunk. t must have no gaps; values have no nulls.
    """
    reach = F.sequence(F.floor(F.col("t") / chunk), F.floor((F.col("t") + lags) / chunk))
    rows = series.select("series_id", "t", "values", F.explode(reach).alias("_chunk"))

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, z = pdf["t"].to_numpy(), np.stack(pdf["values"].to_list())
        at = np.flatnonzero((t >= max(lags, key[1] * chunk)) & (t < (key[1] + 1) * chunk))
        x = np.concatenate([np.ones((len(at), 1)), *[z[at - i] for i in range(lags + 1)]], 1)
        return pd.DataFrame({"series_id": [key[0]], "cells": [(x.T @ x).ravel()]})

    each = rows.groupBy("series_id", "_chunk").applyInPandas(products, "series_id string, cells array<double>")
    return each.select("series_id", F.posexplode("cells").alias("at", "x")).groupBy("series_id", "at").agg(F.sum("x").alias("total"))


def lag_criteria(products: DataFrame, lags: int, channels: int) -> DataFrame:
    """(series_id, lag, rss, aic, chosen, weights): for each number of lags the residual sum over all channels, and Akaike's
    criterion; chosen is the first with the least, and has the weights, a row a channel: the constant, then the channels
    of each lag.

    The lags share their rows, so all come from one matrix: eliminating the constant and then lag after lag leaves each
    model's residual products. A singular lag (a constant channel, too few rows) has no criterion and ends the search. One
    matrix, of the parameters' size, is all that a task holds.
    """
    k = channels

    def criteria(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("at")["total"].to_numpy().reshape(1 + k * (lags + 1), -1)
        rows, m, n = g[0, 0], g.copy(), 0
        out = []
        for pivots in ([0], *[range(1 + k * p, 1 + k * (p + 1)) for p in range(1, lags + 1)]):
            for i in pivots:
                if m[i, i] <= 1e-9 * max(1.0, g[i, i]):
                    break
                m -= np.outer(m[:, i], m[i]) / m[i, i]
            else:
                rest = m[1 : 1 + k, 1 : 1 + k]
                sign, logs = np.linalg.slogdet(rest / rows)
                if sign > 0:
                    out.append((n, float(np.trace(rest)), float(logs + 2 * (k * k * n + k) / rows)))
                    n += 1
                    continue
            break
        best = min(out, key=lambda r: (r[2], r[0]))[0] if out else -1
        rest = np.r_[0, 1 + k : 1 + k * (best + 1)] if best >= 0 else np.empty(0, int)
        weights = np.linalg.solve(g[np.ix_(rest, rest)], g[rest, 1 : 1 + k]).T.tolist() if out else None
        return pd.DataFrame([(key[0], *r, r[0] == best, weights if r[0] == best else None) for r in out], columns=["series_id", "lag", "rss", "aic", "chosen", "weights"])

    return products.groupBy("series_id").applyInPandas(criteria, "series_id string, lag int, rss double, aic double, chosen boolean, weights array<array<double>>")


def lag_forecast(series: DataFrame, criteria: DataFrame, lags: int) -> DataFrame:
    """pred and error (values less pred, both arrays) of every row that has `lags` rows before it, by its series' chosen
    weights."""
    past = rolling(series, lags, {"_past": lambda w: F.collect_list("values").over(w.rowsBetween(-lags, -1))}).where(F.size("_past") == lags)
    rows = past.join(criteria.where("chosen").select("series_id", "lag", "weights"), "series_id")
    x = F.concat(F.array(F.lit(1.0)), F.flatten(F.slice(F.reverse("_past"), F.lit(1), F.col("lag"))))
    pred = F.transform("weights", lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return rows.select("series_id", "t", "values", "lag", pred.alias("pred")).withColumn("error", F.zip_with("values", "pred", lambda a, b: a - b))


def lag_criteria_sql(lags: int) -> str:
    """Tables up to cr (lag, rss, aic) for d (t, c0 .. c3): products by a join, elimination by a recursive query."""
    import itertools

    cell = lambda i, j: f"m[{i + 2}][{j + 2}]"
    sign = lambda p: (-1) ** sum(a > b for a, b in itertools.combinations(p, 2))
    determinant = " + ".join(f"({sign(p)}) * {' * '.join(cell(i, j) for i, j in enumerate(p))}" for p in itertools.permutations(range(4)))
    return f"""me AS (SELECT {', '.join(f'avg(c{i}) AS m{i}, stddev_pop(c{i}) AS s{i}' for i in range(4))} FROM d),
z AS (SELECT t, unnest([0, 1, 2, 3]) AS c, unnest([{', '.join(f'(c{i} - m{i}) / s{i}' for i in range(4))}]) AS v FROM d, me),
x AS (SELECT t, 0 AS q, 1.0::DOUBLE AS v FROM d WHERE t >= {lags} UNION ALL SELECT z.t + i, 1 + 4 * i + c, v FROM z, range({lags + 1}) r(i) WHERE z.t + i >= {lags} AND z.t + i <= (SELECT max(t) FROM d)),
g AS (SELECT a.q AS i, b.q AS j, sum(a.v * b.v) AS g FROM x a JOIN x b ON b.t = a.t GROUP BY ALL),
el AS (SELECT 0 AS s, (SELECT list(r ORDER BY i) FROM (SELECT i, list(g ORDER BY j) AS r FROM g GROUP BY i)) AS m, 1 AS p
  UNION ALL SELECT s + 1, list_transform(m, lambda r: list_transform(list_zip(r, m[p]), lambda y: y[1] - r[p] * y[2] / m[p][p])), s + 6 FROM el WHERE s < {1 + 4 * lags}),
cr AS (SELECT (s - 1) // 4 AS lag, m[2][2] + m[3][3] + m[4][4] + m[5][5] AS rss, ln({determinant}) - 4 * ln(n) + 2 * (16 * ((s - 1) // 4) + 4) / n AS aic
  FROM el, (SELECT count(*)::DOUBLE AS n FROM d WHERE t >= {lags}) WHERE s % 4 = 1)"""
