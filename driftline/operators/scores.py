"""Anomaly scores over nonconformity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.math import clip, normal_cdf, normal_cdf_sql, uniform_p_value
from driftline.operators.frames import CHUNK, NC, NC_SQL, Frames, rolling
from driftline.sources.series import numbered

SHORT, LONG, FLOOR = 10, 50, 0.5


def _over_nonconformity(rows: DataFrame, length: int, columns: Frames) -> DataFrame:
    """columns over frames of nc, of at most `length` rows. Rows of values only get their nonconformity in the same frames,
    one row longer, so that both take one shuffle and one sort."""
    return rolling(rows, length - 1, columns) if "nc" in rows.columns else rolling(rows, length, [NC, columns])


def average_of_window(nc: DataFrame, length: int = 50) -> DataFrame:
    """score: the mean of nc over the last `length` rows; from the first full window on. Without a column nc it is that of
    the values."""
    return _over_nonconformity(nc, length, {"score": lambda w: F.avg("nc").over(w.rowsBetween(-(length - 1), 0))}).where(F.col("t") >= length - 1)


def anomaly_likelihood(nc: DataFrame, short: int = SHORT, long: int = LONG, floor: float = FLOOR) -> DataFrame:
    """score: the normal distribution function of how far the short mean is above the long mean, in deviations of the
    long window or `floor` if they are smaller; from the first full long window on. Without a column nc it is that of the
    values."""
    over = lambda w, n: w.rowsBetween(-(n - 1), 0)
    out = _over_nonconformity(nc, long, {"m_short": lambda w: F.avg("nc").over(over(w, short)), "m_long": lambda w: F.avg("nc").over(over(w, long)), "sd": lambda w: F.stddev_samp("nc").over(over(w, long))})
    out = out.where(F.col("t") >= long - 1).withColumn("z", (F.col("m_short") - F.col("m_long")) / F.greatest("sd", F.lit(floor)))
    return out.withColumn("score", normal_cdf(F.col("z"))).drop("m_short", "m_long", "sd", "z")


def likelihood_sql(short: int = SHORT, long: int = LONG, floor: float = FLOOR) -> str:
    return f"""{NC_SQL}, z AS (SELECT series_id, t, value, is_anomaly, nc, (avg(nc) OVER s - avg(nc) OVER l) / greatest(stddev_samp(nc) OVER l, {floor}::DOUBLE) AS z FROM n
  WINDOW s AS (PARTITION BY series_id ORDER BY t ROWS {short - 1} PRECEDING), l AS (PARTITION BY series_id ORDER BY t ROWS {long - 1} PRECEDING)),
a AS (SELECT series_id, t, value, is_anomaly, nc, {normal_cdf_sql('z')} AS score FROM z WHERE t >= {long - 1})"""


def likelihood_of_batches(nc: DataFrame, start: int = 100, long: int = LONG, short: int = SHORT, floor: float = FLOOR) -> DataFrame:
    """The likelihood whose variance takes the square of each batch's sum for the sum of squares, in closed form: batches
    have `long` rows, and the last batch before `start` is the warm-up."""
    b = nc.where(F.col("t") >= start - long).withColumn("batch", F.floor((F.col("t") - start) / long).cast("long"))
    inside = Window.partitionBy("series_id", "batch").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"i": F.pmod(F.col("t") - start, F.lit(long)), "prefix": F.sum("nc").over(inside)})
    sums = b.groupBy("series_id", "batch").agg(F.sum("nc").alias("whole"), F.sum(F.col("nc") * F.col("nc")).alias("squares"))
    before = sums.select("series_id", (F.col("batch") + 1).alias("batch"), F.col("whole").alias("last"))
    warm = sums.where("batch = -1").select("series_id", (F.col("squares") - F.col("whole") * F.col("whole")).alias("c0"))
    earlier = b.select("series_id", (F.col("batch") + 1).alias("batch"), "i", F.col("prefix").alias("earlier"))
    out = b.where("batch >= 0").join(before, ["series_id", "batch"]).join(earlier, ["series_id", "batch", "i"]).join(warm, "series_id")
    sum2 = F.col("c0") + F.col("last") * F.col("last") + F.col("prefix") * F.col("prefix") - F.col("earlier") * F.col("earlier")
    s_long = F.col("last") + F.col("prefix") - F.col("earlier")
    means = rolling(nc, short - 1, {"m_short": lambda w: F.avg("nc").over(w.rowsBetween(-(short - 1), 0))}).select("series_id", "t", "m_short")
    out = out.join(means, ["series_id", "t"])
    capped = clip(s_long, 1e-6, 1e6)
    sd = F.sqrt(clip((sum2 - capped * capped / long) / (long - 1), 1e-6, 1e20))
    out = out.withColumn("z", (F.col("m_short") - s_long / long) / F.greatest(sd, F.lit(floor)))
    return out.select("series_id", "t", normal_cdf(F.col("z")).alias("score"))


def likelihood_of_batches_sql(start: int = 100, long: int = LONG, short: int = SHORT, floor: float = FLOOR) -> str:
    return f"""{NC_SQL}, b AS (SELECT *, floor((t - {start}) / {long}.0)::BIGINT AS batch FROM n WHERE t >= {start - long}),
p AS (SELECT *, t - {start} - batch * {long} AS i, sum(nc) OVER (PARTITION BY series_id, batch ORDER BY t) AS prefix FROM b),
s AS (SELECT series_id, batch, sum(nc) AS whole, sum(nc * nc) AS squares FROM b GROUP BY ALL),
m AS (SELECT series_id, t, avg(nc) OVER (PARTITION BY series_id ORDER BY t ROWS {short - 1} PRECEDING) AS m_short FROM n),
q AS (SELECT p.series_id, p.t, m.m_short, w.squares - w.whole * w.whole + l.whole * l.whole + p.prefix * p.prefix - g.prefix * g.prefix AS sum2, l.whole + p.prefix - g.prefix AS s_long
  FROM p JOIN s l ON l.series_id = p.series_id AND l.batch = p.batch - 1 JOIN p g ON g.series_id = p.series_id AND g.batch = p.batch - 1 AND g.i = p.i
  JOIN s w ON w.series_id = p.series_id AND w.batch = -1 JOIN m ON m.series_id = p.series_id AND m.t = p.t WHERE p.batch >= 0),
z AS (SELECT series_id, t, (m_short - s_long / {long}) / greatest(sqrt(greatest(least((sum2 - pow(greatest(least(s_long, 1e6), 1e-6), 2) / {long}) / {long - 1}, 1e20), 1e-6)), {floor}::DOUBLE) AS z FROM q)
SELECT series_id, t, round({normal_cdf_sql('z')}, 6) AS score FROM z"""


def likelihood_what_if(nc: DataFrame, factor: float = 2.0, short: int = SHORT, long: int = LONG, floor: float = FLOOR) -> DataFrame:
    """The likelihood each row would have if its nonconformity were `factor` times what it is; nothing is updated."""
    back = lambda w, n: w.rowsBetween(-(n - 1), -1)
    out = rolling(nc, long - 1, {"ss": lambda w: F.sum("nc").over(back(w, short)), "sl": lambda w: F.sum("nc").over(back(w, long)), "s2": lambda w: F.sum(F.col("nc") * F.col("nc")).over(back(w, long))})
    h = F.col("nc") * F.lit(factor)
    total = F.col("sl") + h
    sd = F.sqrt(F.greatest((F.col("s2") + h * h - total * total / long) / (long - 1), F.lit(0.0)))
    out = out.where(F.col("t") >= long - 1).withColumn("z", ((F.col("ss") + h) / short - total / long) / F.greatest(sd, F.lit(floor)))
    return out.select("series_id", "t", normal_cdf(F.col("z")).alias("score"))


def likelihood_what_if_sql(factor: float = 2.0, short: int = SHORT, long: int = LONG, floor: float = FLOOR) -> str:
    return f"""{NC_SQL}, w AS (SELECT series_id, t, {factor} * nc AS h, sum(nc) OVER s AS ss, sum(nc) OVER l AS sl, sum(nc * nc) OVER l AS s2 FROM n
  WINDOW s AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {short - 1} PRECEDING AND 1 PRECEDING), l AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {long - 1} PRECEDING AND 1 PRECEDING)),
z AS (SELECT series_id, t, ((ss + h) / {short} - (sl + h) / {long}) / greatest(sqrt(greatest((s2 + h * h - (sl + h) * (sl + h) / {long}) / {long - 1}, 0.0::DOUBLE)), {floor}::DOUBLE) AS z FROM w WHERE t >= {long - 1})
SELECT series_id, t, round({normal_cdf_sql('z')}, 6) AS score FROM z"""


def confidence(nc: DataFrame, n: int = 50) -> DataFrame:
    """confidence: the share of the last n rows whose nonconformity is no less than this row's."""
    out = rolling(nc, n - 1, {"_frame": lambda w: F.collect_list("nc").over(w.rowsBetween(-(n - 1), 0))}).where(F.col("t") >= n - 1)
    return out.withColumn("confidence", F.size(F.filter("_frame", lambda x: x >= F.col("nc"))) / F.lit(float(n))).drop("_frame")


def uniform_statistic(conf: DataFrame, window: int = 100, every: int = 50, first: int = 49) -> DataFrame:
    """d: the largest distance between the distribution of the distinct confidences of the last `window` rows and the
    uniform one, and their number; every `every` rows from the first full window on. conf starts at row `first`."""
    out = rolling(conf.withColumn("t", F.col("t") - first), window - 1, {"c": lambda w: F.collect_list("confidence").over(w.rowsBetween(-(window - 1), 0))})
    out = out.where((F.size("c") == window) & (F.pmod(F.col("t") + 1, F.lit(every)) == 0)).select("series_id", (F.col("t") + first).alias("t"), F.array_sort(F.array_distinct("c")).alias("c"))
    n = F.size("c")
    far = F.transform("c", lambda x, i: F.greatest((i + 1) / n - x, x - i / n))
    return out.select("series_id", "t", n.cast("long").alias("n"), F.array_max(far).alias("d"))


def p_values(statistics: DataFrame, least: int = 31) -> DataFrame:
    """statistics (n, d and more) with p_value, null under `least` distinct values. The distribution is worked out once for
    each n and d that occur, however many rows share them."""
    pairs = statistics.where(F.col("n") >= least).select("n", "d").distinct()
    return statistics.join(pairs.withColumn("p_value", uniform_p_value(F.col("n"), F.col("d"))), ["n", "d"], "left")


#: What p-values are cut to before their logarithm, the first scale of scores, and how it is moved.
LEAST_P, FIRST_SCALE, NEAR, BEYOND = 1e-40, 1.0, 0.9, 5.0


def scale_steps(x: np.ndarray, scale: float) -> np.ndarray:
    """The scale in force at each value, and last the one behind them: a value over 0.9 times the scale moves it to 5 above
    that value, from the next one on."""
    out = np.empty(len(x) + 1)
    for i, v in enumerate(x.tolist()):
        out[i] = scale
        if v > NEAR * scale:
            scale = v + BEYOND
    out[-1] = scale
    return out


def scale_function(x: np.ndarray) -> tuple[list[float], list[float]]:
    """What a run of values makes of any scale: the scale behind it is ends[i] for the first i with tops[i] > 0.9 times the
    scale before, and that scale itself if there is none. Only a value above all before it can be the first to move a
    scale, so tops are those, a few of many; from there on all is fixed. Such functions follow one another."""
    tops = np.flatnonzero(x > np.concatenate([[-np.inf], np.maximum.accumulate(x)[:-1]])) if len(x) else np.empty(0, int)
    return x[tops].tolist(), [float(scale_steps(x[i + 1 :], float(x[i]) + BEYOND)[-1]) for i in tops]


def unified(pvalues: DataFrame, window: int = 25, chunk: int = CHUNK) -> DataFrame:
    """pvalues (series_id, t, p_value) with score: the negative logarithm of the p-value between the least and the largest
    of the last `window` ones, or the scale so far if that is larger. Rows without a p-value have no score and don't count.

    The scale is a state that each row may move, and depends on all rows before. Chunks of a series are made functions of
    the scale that they start with, side by side; a fold over those, a row a chunk, gives each chunk its start; then
    chunks are scored side by side. No task holds a series.
    """
    rows = numbered(pvalues.where("p_value is not null"), "series_id", ["t"], F.floor(F.col("t") / chunk), "i")
    rows = rows.select("series_id", F.col("i").alias("t"), F.col("t").alias("_t"), "p_value", (-F.log(clip(F.col("p_value"), LEAST_P, 1.0))).alias("nl"))
    over = lambda f: lambda w: f("nl").over(w.rowsBetween(-(window - 1), 0))
    rows = rolling(rows, window - 1, {"least": over(F.min), "most": over(F.max)}).withColumn("chunk", F.floor(F.col("t") / chunk))

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tops, ends = scale_function(pdf.sort_values("t")["most"].to_numpy())
        return pd.DataFrame({"series_id": [key[0]], "chunk": [key[1]], "tops": [tops], "ends": [ends]})

    def starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        scale, out = FIRST_SCALE, []
        for chunk_, tops, ends in pdf.sort_values("chunk")[["chunk", "tops", "ends"]].itertuples(index=False):
            out.append((key[0], chunk_, scale))
            scale = next((e for t, e in zip(tops, ends, strict=True) if t > NEAR * scale), scale)
        return pd.DataFrame(out, columns=["series_id", "chunk", "start"])

    def scored(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        scale = scale_steps(pdf["most"].to_numpy(), float(pdf["start"].iloc[0]))[:-1]
        low = pdf["least"].to_numpy()
        score = (pdf["nl"].to_numpy() - low) / np.clip(np.maximum(scale, pdf["most"].to_numpy()) - low, 1e-6, 1e6)
        return pd.DataFrame({"series_id": key[0], "t": pdf["_t"], "p_value": pdf["p_value"], "scale": scale, "score": score})

    each = rows.groupBy("series_id", "chunk").applyInPandas(summary, "series_id string, chunk long, tops array<double>, ends array<double>")
    first = each.groupBy("series_id").applyInPandas(starts, "series_id string, chunk long, start double")
    return rows.join(first, ["series_id", "chunk"]).groupBy("series_id", "chunk").applyInPandas(scored, "series_id string, t long, p_value double, scale double, score double")


def unified_sql(window: int = 25) -> str:
    """From pt (series_id, t, p): the same by a recursive query, a row of each series a step."""
    return f"""un AS (SELECT series_id, t, p, row_number() OVER o AS i, -ln(greatest(least(p, 1.0), {LEAST_P}::DOUBLE)) AS nl FROM pt WINDOW o AS (PARTITION BY series_id ORDER BY t)),
ux AS (SELECT *, min(nl) OVER w AS low, max(nl) OVER w AS top FROM un WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS {window - 1} PRECEDING)),
us AS (SELECT series_id, t, p, i, nl, low, top, {FIRST_SCALE}::DOUBLE AS scale FROM ux WHERE i = 1
  UNION ALL SELECT x.series_id, x.t, x.p, x.i, x.nl, x.low, x.top, CASE WHEN us.top > {NEAR}::DOUBLE * us.scale THEN us.top + {BEYOND} ELSE us.scale END FROM us JOIN ux x ON x.series_id = us.series_id AND x.i = us.i + 1)
SELECT series_id, t, round(p, 9) AS p_value, round(scale, 6) AS scale, round((nl - low) / greatest(least(greatest(scale, top) - low, 1e6), 1e-6), 6) AS score FROM us"""
