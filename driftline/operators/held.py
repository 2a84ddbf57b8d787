"""Score-aware training sets over time, and confidence by what a training set holds when a row comes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.math import hash_uniform, hash_uniform_sql
from driftline.operators.frames import CHUNK
from driftline.operators.training import priority, versions_asof
from driftline.sources.store import written

#: Chunks that are looked through together once their hopeless rows are gone.
FAN = 16


def through_batches(p: np.ndarray, t: np.ndarray, k: np.ndarray, held_p: np.ndarray, held_t: np.ndarray) -> Iterator[tuple[int, int, float, list[int], np.ndarray]]:
    """For each batch (rows of equal k, in order): its rows lo to hi, the least priority held before it, the rows that come
    in and the held ones (by t) that go for them, in the same order. Each row in turn stands against the least held one
    that has not gone yet; new rows do not stand against each other."""
    cuts = [0, *(np.flatnonzero(np.diff(k)) + 1), len(k)] if len(k) else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        order = np.lexsort((held_t, held_p))
        held_p, held_t = held_p[order], held_t[order]
        come: list[int] = []
        for i in lo + np.flatnonzero(p[lo:hi] > held_p[0]):
            if len(come) < len(held_p) and p[i] > held_p[len(come)]:
                come.append(int(i))
        yield lo, hi, float(held_p[0]), come, held_t[: len(come)]
        held_p, held_t = np.concatenate([held_p[len(come) :], p[come]]), np.concatenate([held_t[len(come) :], t[come]])


def aware_writes(scored: DataFrame, n: int, step: int, seed: int = 42, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(series_id, t, priority, from_t, until_t): the rows that a score-aware reservoir of n rows holds, and from which row
    of the series to before which other one (until_t is null for what stays). scored: series_id, t without gaps up to the
    last row, score.

    The first n rows hold from row n - 1 on, with priorities of random scores. Each later batch of `step` rows, once it is
    whole, goes through the reservoir as through_batches says. Rows without a score (null or NaN) never come in; series of
    fewer than n rows, and rows with a null series_id, have no writes.

    A reservoir that starts lower stays lower: after any batch it has, under every bound, as many rows or more. So a chunk
    of a series that is gone through alone, from a reservoir of nothing, gives a bound from below on the least priority
    held at each batch, and rows no higher can't come in and change nothing. Chunks drop theirs side by side, then `fan`
    chunks together, and so on; what is left grows with the logarithm of the rows, and only that is put in order by
    series. The result is that of going through all rows.
    """
    if step > n:
        raise ValueError("a batch must fit into the reservoir")
    key, t = F.col("series_id"), F.col("t")
    rounded = lambda score: F.round(priority(score, hash_uniform(seed, key, t)), 9).alias("priority")
    ends = scored.groupBy("series_id").agg((F.max("t") + 1).alias("_n")).where(F.col("_n") >= n)
    first = ends.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("t"), F.lit(-1).cast("long").alias("k"))
    first = first.select("series_id", "t", "k", rounded(hash_uniform(seed + 1, key, t)))
    later = scored.where((t >= n) & F.col("score").isNotNull() & ~F.isnan("score")).select("series_id", "t", F.floor((t - n) / step).cast("long").alias("k"), rounded(F.col("score")))
    later = later.join(ends, "series_id").where(n + (F.col("k") + 1) * step <= F.col("_n")).drop("_n")
    rows = first.unionByName(later)
    schema = "series_id string, t long, k long, priority double"

    def arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """Rows after the first ones, in order, and what is held before them."""
        start = pdf["k"] < 0
        held = (pdf.loc[start, "priority"].to_numpy(), pdf.loc[start, "t"].to_numpy()) if start.any() else (np.full(n, -np.inf), np.full(n, -1))
        return pdf[~start].sort_values("t"), *held

    def hopeful(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        later, held_p, held_t = arrays(pdf)
        p = later["priority"].to_numpy()
        keep = np.zeros(len(p), bool)
        for lo, hi, least, _, _ in through_batches(p, later["t"].to_numpy(), later["k"].to_numpy(), held_p, held_t):
            keep[lo:hi] = p[lo:hi] > least
        return pd.concat([pdf[pdf["k"] < 0], later[keep]])[["series_id", "t", "k", "priority"]]

    def spans(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        later, held_p, held_t = arrays(pdf)
        p, at, k = later["priority"].to_numpy(), later["t"].to_numpy(), later["k"].to_numpy()
        out, until = [(t, x, n - 1) for t, x in zip(held_t.tolist(), held_p.tolist(), strict=True)], {}
        for lo, _, _, come, gone in through_batches(p, at, k, held_p, held_t):
            from_t = n + (int(k[lo]) + 1) * step - 1
            out += [(int(at[i]), float(p[i]), from_t) for i in come]
            until |= dict.fromkeys(gone.tolist(), from_t)
        found = pd.DataFrame(out, columns=["t", "priority", "from_t"])
        return found.assign(series_id=key[0], until_t=found["t"].map(until).astype("Int64"))[["series_id", "t", "priority", "from_t", "until_t"]]

    per = max(1, chunk // step)
    part = lambda df: df.groupBy("series_id", F.floor(F.greatest("k", F.lit(0)) / per).alias("_part"))
    rows = written(part(rows).applyInPandas(hopeful, schema))
    top = rows.agg(F.max("k")).first()[0] or 0
    while per * fan <= top:
        per *= fan
        rows = written(part(rows).applyInPandas(hopeful, schema))
    return rows.groupBy("series_id").applyInPandas(spans, "series_id string, t long, priority double, from_t long, until_t long")


def aware_writes_sql(n: int, step: int, seed: int = 42) -> str:
    """From p (series_id, t, priority), in a recursive query: tables up to aw (series_id, t, priority, from_t, until_t), a row of each series a
    step."""
    u = lambda i: hash_uniform_sql(seed + i, "series_id", "t")
    whole = f"({n} + ((t - {n}) // {step} + 1) * {step} - 1)"
    return f"""ln AS (SELECT series_id, max(t) + 1 AS n FROM p GROUP BY series_id),
ir AS (SELECT series_id, n, t, round(pow(0.7::DOUBLE + 0.2::DOUBLE * {u(0)}, 3.0::DOUBLE / exp(-3.0::DOUBLE * {u(1)})), 9) AS priority FROM (SELECT series_id, n, unnest(range({n})) AS t FROM ln WHERE n >= {n})),
wk AS (SELECT series_id, {n - 1}::BIGINT AS t, n, list_sort(list({{'p': priority, 't': t}})) AS held, list({{'p': priority, 't': t}}) FILTER (false) AS fresh, NULL::DOUBLE AS priority, NULL::BIGINT AS gone FROM ir GROUP BY series_id, n
  UNION ALL SELECT series_id, t, n, CASE WHEN hit THEN h[2:] ELSE h END, CASE WHEN hit THEN list_append(f, {{'p': priority, 't': t}}) ELSE f END, priority, CASE WHEN hit THEN h[1].t END
  FROM (SELECT x.series_id, x.t, b.n, x.priority, h, f, coalesce(x.priority > h[1].p, false) AS hit
    FROM (SELECT series_id, t + 1 AS t, n, CASE WHEN (t + 1 - {n}) % {step} = 0 THEN list_sort(list_concat(held, fresh)) ELSE held END AS h, CASE WHEN (t + 1 - {n}) % {step} = 0 THEN [] ELSE fresh END AS f FROM wk) b
    JOIN p x ON x.series_id = b.series_id AND x.t = b.t) WHERE {whole} < n),
aw AS (SELECT i.*, g.until_t FROM (SELECT series_id, t, priority, {n - 1}::BIGINT AS from_t FROM ir UNION ALL SELECT series_id, t, priority, {whole} FROM wk WHERE gone IS NOT NULL) i
  LEFT JOIN (SELECT series_id, gone, {whole} AS until_t FROM wk WHERE gone IS NOT NULL) g ON g.series_id = i.series_id AND g.gone = i.t)"""


def confidence_of_held(nc: DataFrame, writes: DataFrame, n: int, chunk: int | None = None) -> DataFrame:
    """(series_id, t, nc, confidence) of each row that comes when the training set is full: the share of the n rows held
    before it whose nonconformity is no less than its own; null for a null nc. writes: series_id, t, from_t, until_t, as
    aware_writes or reservoir_writes give them; a row counts as held by rows after from_t up to until_t.

    Between two changes a set is fixed, and there are few changes, so sets are spread by change. In each such span, and
    each chunk of a long one, held rows and coming rows are put in order together, and one count runs through them; no row
    is paired with the rows of a set. A chunk has 16 times as many rows as a set, or CHUNK, so that sets are few beside rows.
    """
    chunk = chunk or max(CHUNK, 16 * n)
    writes = written(writes.select("series_id", "t", "from_t", "until_t"))
    changes = writes.select("series_id", "from_t").distinct()
    changes = changes.withColumn("version", F.row_number().over(Window.partitionBy("series_id").orderBy("from_t")))
    before = versions_asof(nc.where("t > 0").select("series_id", (F.col("t") - 1).alias("t")), changes).where("version is not null")
    rows = before.select("series_id", (F.col("t") + 1).alias("t"), "version").join(nc.select("series_id", "t", "nc"), ["series_id", "t"])
    rows = written(rows.withColumn("_part", F.floor(F.col("t") / chunk)))
    last = changes.groupBy("series_id").agg(F.max("version").alias("_last"))
    held = writes.join(nc.select("series_id", "t", "nc"), ["series_id", "t"]).join(changes, ["series_id", "from_t"])
    held = held.join(changes.select("series_id", F.col("from_t").alias("until_t"), (F.col("version") - 1).alias("_until")), ["series_id", "until_t"], "left").join(last, "series_id")
    held = held.select("series_id", F.explode(F.sequence("version", F.coalesce("_until", "_last"))).alias("version"), "nc")
    held = held.join(rows.select("series_id", "version", "_part").distinct(), ["series_id", "version"])
    both = rows.withColumn("_held", F.lit(0)).unionByName(held.select("series_id", "version", "_part", F.lit(None).cast("long").alias("t"), "nc", F.lit(1).alias("_held")))
    # equal ones count on both sides: the frame runs up to the last peer
    upto = Window.partitionBy("series_id", "version", "_part").orderBy(F.desc("nc")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("confidence", F.when(F.col("nc").isNotNull(), F.sum("_held").over(upto) / F.lit(float(n))))
    return both.where("_held = 0").select("series_id", "t", "nc", "confidence")


def confidence_of_held_sql(writes: str, n: int, into: str = "f") -> str:
    """Table `into` (series_id, t, confidence) from n (series_id, t, nc) and a table of writes."""
    return f"""hd AS (SELECT w.series_id, w.from_t, w.until_t, n.nc FROM {writes} w JOIN n ON n.series_id = w.series_id AND n.t = w.t),
{into} AS (SELECT n.series_id, n.t, count(*) FILTER (hd.nc >= n.nc) / {float(n)}::DOUBLE AS confidence FROM n JOIN hd ON hd.series_id = n.series_id AND n.t > hd.from_t AND n.t <= coalesce(hd.until_t, n.t) GROUP BY n.series_id, n.t)"""


def two_sample(a: np.ndarray, b: np.ndarray) -> float:
    """The largest distance between the distributions of two samples."""
    a, b = np.sort(a, axis=None), np.sort(b, axis=None)
    x = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, x, side="right") / len(a) - np.searchsorted(b, x, side="right") / len(b)).max())


def drift_of_held(vectors: DataFrame, writes: DataFrame, n: int, every: int, kind: str = "ks", alpha: float = 0.05, force: bool = False) -> DataFrame:
    """(series_id, upto, nth, d, mu_shift, sigma, sigma0, drift, version): at every `every`-th change of a training set over
    time, its distance from the set at the last drift, or the first full one; version counts the drifts up to there.
    vectors: series_id, t, fv (an array of channels, each an array of values; none null); writes as for confidence_of_held.

    d is the largest two-sample statistic of the channels, over all their values; mu_shift the norm of the difference of
    cell means, sigma and sigma0 those of the cells' deviations now and then. kind "ks" holds d against the critical
    value, "mu_sigma" mu_shift against sigma0 and sigma against half and twice of it; force: every check is a drift.

    Each check depends on the one before, so a series is one task; but it reads only the rows that were ever held, whose
    number grows with the logarithm of a series, and holds those. A series whose set never changes has no checks.
    """
    if kind not in ("ks", "mu_sigma"):
        raise ValueError(f"no such kind of drift: {kind}")
    bound = float(np.sqrt(2 / n * np.log(2 / alpha)))
    norm = lambda v: float(np.sqrt(np.clip(v, 1e-6, 1e20).sum()))

    def checks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.stack(v) for v in pdf["fv"]])
        start, until = pdf["from_t"].to_numpy(), pdf["until_t"].fillna(np.inf).to_numpy(float)
        set_at = lambda at: x[(start <= at) & (until > at)]
        changes, out, version = np.unique(start)[1:], [], 0
        then = set_at(start.min())
        for no in range(every, len(changes) + 1, every):
            now = set_at(changes[no - 1])
            d = max(two_sample(now[:, c], then[:, c]) for c in range(x.shape[1]))
            shift, sigma, sigma0 = float(np.linalg.norm(now.mean(0) - then.mean(0))), norm(now.var(0, ddof=1)), norm(then.var(0))
            drift = force or (d > bound if kind == "ks" else shift > sigma0 or sigma < sigma0 / 2 or sigma > 2 * sigma0)
            if drift:
                then, version = now, version + 1
            out.append((key[0], int(changes[no - 1]), no, d, shift, sigma, sigma0, drift, version))
        return pd.DataFrame(out, columns=["series_id", "upto", "nth", "d", "mu_shift", "sigma", "sigma0", "drift", "version"])

    held = writes.select("series_id", "t", "from_t", "until_t").join(vectors.select("series_id", "t", "fv"), ["series_id", "t"])
    return held.groupBy("series_id").applyInPandas(checks, "series_id string, upto long, nth int, d double, mu_shift double, sigma double, sigma0 double, drift boolean, version int")


def drift_of_held_sql(writes: str, n: int, every: int, kind: str = "ks", alpha: float = 0.05) -> str:
    """From e (series_id, t, fv: one channel's values) and a table of writes, in a recursive query: tables up to dr."""
    drift = f"d > {float(np.sqrt(2 / n * np.log(2 / alpha)))!r}::DOUBLE" if kind == "ks" else "mu_shift > sigma0 OR sigma < sigma0 / 2 OR sigma > sigma0 * 2"
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda z: greatest(least(z, 1e20), 1e-6))))"
    below = lambda v: f"len(list_filter({v}, lambda q: q <= z)) / len({v})::DOUBLE"
    return f"""hw AS (SELECT w.series_id, w.t, w.from_t, w.until_t, e.fv, min(w.from_t) OVER (PARTITION BY w.series_id) AS full_t FROM {writes} w JOIN e ON e.series_id = w.series_id AND e.t = w.t),
hc AS (SELECT series_id, from_t AS upto, row_number() OVER (PARTITION BY series_id ORDER BY from_t)::INTEGER - 1 AS nth FROM (SELECT DISTINCT series_id, from_t FROM hw)),
hm AS (SELECT c.series_id, c.upto, c.nth, c.nth // {every} AS i, w.fv FROM hc c JOIN hw w ON w.series_id = c.series_id AND w.from_t <= c.upto AND coalesce(w.until_t > c.upto, true) WHERE c.nth % {every} = 0),
hj AS (SELECT series_id, i, j, avg(x) AS mu, var_samp(x) AS v, var_pop(x) AS v0 FROM (SELECT series_id, i, unnest(fv) AS x, generate_subscripts(fv, 1) AS j FROM hm) GROUP BY ALL),
hx AS (SELECT * FROM (SELECT series_id, upto, nth, i, flatten(list(fv)) AS a FROM hm GROUP BY ALL) JOIN (SELECT series_id, i, list(mu ORDER BY j) AS mu, list(v ORDER BY j) AS v, list(v0 ORDER BY j) AS v0 FROM hj GROUP BY ALL) USING (series_id, i)),
dr AS (SELECT series_id, i, upto, nth, NULL::DOUBLE AS d, NULL::DOUBLE AS mu_shift, NULL::DOUBLE AS sigma, NULL::DOUBLE AS sigma0, false AS drift, 0 AS version, a, mu, v0 FROM hx WHERE i = 0
  UNION ALL SELECT series_id, i, upto, nth, d, mu_shift, sigma, sigma0, drift, version + drift::INTEGER, CASE WHEN drift THEN a ELSE ra END, CASE WHEN drift THEN mu ELSE rmu END, CASE WHEN drift THEN v0 ELSE rv END
  FROM (SELECT *, {drift} AS drift FROM (SELECT s.series_id, s.i, s.upto, s.nth, dr.version, s.a, s.mu, s.v0, dr.a AS ra, dr.mu AS rmu, dr.v0 AS rv,
    list_max(list_transform(list_concat(s.a, dr.a), lambda z: abs({below("s.a")} - {below("dr.a")}))) AS d,
    sqrt(list_sum(list_transform(list_zip(s.mu, dr.mu), lambda z: pow(z[1] - z[2], 2)))) AS mu_shift, {norm("s.v")} AS sigma, {norm("dr.v0")} AS sigma0
    FROM dr JOIN hx s ON s.series_id = dr.series_id AND s.i = dr.i + 1)))"""
