"""Training sets in batch form, and drift of the training set."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.math import clip, hash_uniform, hash_uniform_sql
from driftline.operators.frames import CHUNK, rolling
from driftline.sources.series import numbered
from driftline.sources.store import written


def priority(score: Column, u: Column, lam: float = 3.0, num: float = 3.0) -> Column:
    """u ** (num / exp(-lam * score)) with u moved to [0.7, 0.9): high scores get low priorities."""
    return F.pow(F.lit(0.7) + F.lit(0.2) * u, F.lit(num) / F.exp(F.lit(-lam) * score))


def uniform_reservoir(series: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of each series, each set equally likely: those with the smallest seeded uniforms u."""
    rows = series.withColumn("u", hash_uniform(seed, F.col("series_id"), F.col("t")))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("u", "t"))
    return rows.withColumn("slot", rank).where(F.col("slot") <= n)


def reservoir_writes(series: DataFrame, n: int, step: int, seed: int = 42) -> DataFrame:
    """(series_id, slot, t, from_t, until_t): the rows that a uniform reservoir of n slots holds, and from which row of the
    series to before which other one it holds them (until_t is null for what stays). t must have no gaps; extra columns go.

    The first n rows fill the slots, and hold from row n - 1 on. Each later batch of `step` rows, once it is whole, is let
    in with the chance n / (its last row); its rows then take that many different slots, a random one first and then
    others at a random stride that shares no factor with n. Whether a batch comes in and where its rows go are hashes of
    seed, series and batch, so nothing depends on what came before: a slot's content is its last writer, and a row leaves
    when the next one takes its slot. A slot is written about log(rows / n) times, so no window is long.
    """
    if step > n:
        raise ValueError("a batch must fit into the reservoir")
    strides = F.array(*[F.lit(x) for x in coprimes(n)])
    key, k = F.col("series_id"), F.col("_k")
    ends = series.groupBy("series_id").agg((F.max("t") + 1).alias("_n"))
    batch = series.select("series_id", "t", F.when(F.col("t") >= n, F.floor((F.col("t") - n) / step)).alias("_k"))
    batch = batch.withColumn("from_t", F.when(k.isNull(), n - 1).otherwise(n + (k + 1) * step - 1).cast("long"))
    admitted = k.isNull() | (hash_uniform(seed, key, k) < F.lit(float(n)) / F.col("from_t"))
    at = F.floor(hash_uniform(seed + 1, key, k) * n) + (F.col("t") - n - k * step) * F.get(strides, F.floor(hash_uniform(seed + 2, key, k) * len(coprimes(n))).cast("int"))
    writes = batch.where(admitted).join(ends, "series_id").where(F.col("from_t") < F.col("_n"))
    writes = writes.select("series_id", F.when(k.isNull(), F.col("t")).otherwise(F.pmod(at, F.lit(n))).cast("int").alias("slot"), "t", "from_t")
    return writes.withColumn("until_t", F.lead("from_t").over(Window.partitionBy("series_id", "slot").orderBy("from_t")))


def coprimes(n: int) -> list[int]:
    return [x for x in range(1, max(n, 2)) if math.gcd(x, n) == 1]


def reservoir_at(writes: DataFrame, every: int, last: DataFrame) -> DataFrame:
    """(series_id, at, slot, t): the reservoir's contents at every `every`-th row, all rows side by side: each write is
    spread over the rows at which it is in force. last: (series_id, n) with the length of each series."""
    until = F.least(F.coalesce("until_t", "n"), F.col("n")) - 1
    span = writes.join(last, "series_id").withColumns({"_lo": F.ceil(F.col("from_t") / every), "_hi": F.floor(until / every)}).where("_lo <= _hi")
    return span.select("series_id", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda k: k * every)).alias("at"), "slot", "t")


def reservoir_writes_sql(n: int, step: int, seed: int = 42) -> str:
    u = lambda i: hash_uniform_sql(seed + i, "series_id", "k")
    return f"""b AS (SELECT series_id, t, value, CASE WHEN t >= {n} THEN (t - {n}) // {step} END AS k, max(t) OVER (PARTITION BY series_id) + 1 AS n FROM e),
f AS (SELECT *, CASE WHEN k IS NULL THEN {n - 1} ELSE {n} + (k + 1) * {step} - 1 END AS from_t FROM b),
wr AS (SELECT series_id, t, value, n, from_t, CASE WHEN k IS NULL THEN t ELSE (floor({u(1)} * {n})::BIGINT + (t - {n} - k * {step}) * {coprimes(n)}[floor({u(2)} * {len(coprimes(n))})::BIGINT + 1]) % {n} END AS slot
  FROM f WHERE from_t < n AND (k IS NULL OR {u(0)} < {float(n)}::DOUBLE / from_t))"""


def priority_reservoir(scored: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The n rows of each series with the highest priorities; rows without a score (null or NaN) are never taken."""
    scored = scored.where(F.col("score").isNotNull() & ~F.isnan("score"))
    u = hash_uniform(seed, F.col("series_id"), F.col("t"))
    rows = scored.withColumn("priority", F.round(priority(F.col("score"), u), 9))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("priority"), "t"))
    return rows.withColumn("slot", rank).where(F.col("slot") <= n)


def mu_sigma(series: DataFrame, n: int = 100, length: int = 10, every: int = 50) -> DataFrame:
    """Per check, the distance of the training set's cell means from those of the first full set, and the norms of the
    cells' deviations now and then (mu_shift, sigma, sigma0).

    The training set is the last n vectors of `length` rows, so cell j of it holds n consecutive rows: its mean and
    variance are rolling ones, and the norms sums over `length` of them. No vector is built.
    """
    over = lambda w: w.rowsBetween(-(n - 1), 0)
    cells = rolling(series, n - 1, {"mu": lambda w: F.avg("value").over(over(w)), "var": lambda w: F.var_samp("value").over(over(w)), "var0": lambda w: F.var_pop("value").over(over(w))})
    first = n + length - 2
    frame = lambda c: lambda w: F.collect_list(c).over(w.rowsBetween(-(length - 1), 0))
    sets = rolling(cells, length - 1, {"mus": frame("mu"), "vars": frame("var"), "vars0": frame("var0")})
    sets = sets.where((F.col("t") >= first) & (F.pmod(F.col("t") - first, F.lit(every)) == 0))
    start = sets.where(F.col("t") == first).select("series_id", F.col("mus").alias("mus0"), F.col("vars0").alias("ref"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(total(F.transform(a, lambda v: clip(v, 1e-6, 1e20))))
    shift = F.sqrt(total(F.zip_with("mus", "mus0", lambda a, b: (a - b) * (a - b))))
    out = sets.join(start, "series_id")
    return out.select("series_id", "t", shift.alias("mu_shift"), norm(F.col("vars")).alias("sigma"), norm(F.col("ref")).alias("sigma0"))


def mu_sigma_channels(series: DataFrame, n: int = 100, length: int = 10, every: int = 50) -> DataFrame:
    """mu_sigma of vectors of several channels (values): the norms run over all cells, so they are those of the channels,
    each taken as a series, put together."""
    long = series.select("series_id", "t", F.posexplode("values").alias("ch", "value")).select(F.struct("series_id", "ch").alias("series_id"), "t", "value")
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c)
    return mu_sigma(long, n, length, every).groupBy(F.col("series_id.series_id").alias("series_id"), "t").agg(*[norm(c) for c in ("mu_shift", "sigma", "sigma0")])


def mu_sigma_drift(checks: DataFrame, force: bool = False) -> DataFrame:
    """checks with drift; force: every check counts as one, to try what follows a drift."""
    drift = (F.col("mu_shift") > F.col("sigma0")) | (F.col("sigma") < F.col("sigma0") / 2) | (F.col("sigma") > F.col("sigma0") * 2)
    return checks.withColumn("drift", F.lit(True) if force else drift)


def mu_sigma_sql(n: int = 100, length: int = 10, every: int = 50) -> str:
    first = n + length - 2
    return f"""c AS (SELECT series_id, t, avg(value) OVER w AS mu, var_samp(value) OVER w AS var, var_pop(value) OVER w AS var0 FROM e
  WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS {n - 1} PRECEDING)),
l AS (SELECT a.series_id, a.t, b.mu, b.var, b.var0, z.mu AS mu0, z.var0 AS ref FROM c a
  JOIN c b ON b.series_id = a.series_id AND b.t BETWEEN a.t - {length - 1} AND a.t
  JOIN c z ON z.series_id = a.series_id AND z.t = {first} - (a.t - b.t) WHERE a.t >= {first} AND (a.t - {first}) % {every} = 0),
s AS (SELECT series_id, t, sqrt(sum((mu - mu0) * (mu - mu0))) AS mu_shift, sqrt(sum(greatest(least(var, 1e20), 1e-6))) AS sigma,
  sqrt(sum(greatest(least(ref, 1e20), 1e-6))) AS sigma0 FROM l GROUP BY series_id, t)"""


def ks_two_sample(samples: DataFrame, keys: list[str], side: str = "side", value: str = "x", weight: Column | None = None) -> DataFrame:
    """keys, n1, n2, d: the two-sample Kolmogorov-Smirnov statistic of the values with side 0 and 1. Rows weigh 1 or
    `weight`. Rows without a value play no part.

    Equal values are summed first, so ties cost one row. The sums are dealt by ranges of keys and value and written, so
    that ranges stay; sums of ranges, a row a key and range, give each range what lies below it, and only a range is put
    in order. A key with a third of all values is a third of the ranges.
    """
    w = F.lit(1) if weight is None else weight
    by = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.when(F.col(side) == 0, w).otherwise(0)).alias("a"), F.sum(F.when(F.col(side) == 1, w).otherwise(0)).alias("b"))
    dealt = written(by.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    of_key = Window.partitionBy(*keys)
    below = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    sums = sums.select(*keys, "_range", *[F.sum(f"_{c}").over(of_key).alias(n) for c, n in (("a", "n1"), ("b", "n2"))], *[F.coalesce(F.sum(f"_{c}").over(below), F.lit(0)).alias(f"_below_{c}") for c in "ab"])
    upto = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c, n: (F.col(f"_below_{c}") + F.sum(c).over(upto)) / F.col(n)
    far = dealt.join(sums, [*keys, "_range"]).withColumn("_far", F.abs(share("a", "n1") - share("b", "n2")))
    return far.groupBy(*keys).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("_far").alias("d"))


def ks_bound(r: Column, alpha: float = 0.05) -> Column:
    return F.sqrt(F.lit(2.0) / r * F.lit(math.log(2 / alpha)))


def vector_multiplicity(i: Column, length: int, n: int) -> Column:
    """In how many of n consecutive vectors of `length` rows the i-th of their n + length - 1 rows stands."""
    rows = n + length - 1
    return F.least(i + 1, F.lit(length), F.lit(n), F.lit(rows) - i)


def every_k(flags: DataFrame, k: int) -> DataFrame:
    """no: the running count of the rows where `flag` holds, kept where it is a multiple of k."""
    counted = numbered(flags.where("flag"), "series_id", ["t"], F.floor(F.col("t") / CHUNK), "no")
    return counted.withColumn("no", F.col("no") + 1).where(F.pmod(F.col("no"), F.lit(k)) == 0)


def versions_asof(rows: DataFrame, versions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows with the version in force: the last of versions (series_id, from_t, version) with from_t <= t. Both are put in
    order together, in chunks of a series, so no row meets all versions; each chunk starts with the last version of those
    before it."""
    both = rows.select("series_id", "t", F.lit(None).cast("int").alias("version"), F.lit(1).alias("is_row")).unionByName(versions.select("series_id", F.col("from_t").alias("t"), "version", F.lit(0).alias("is_row")))
    both = both.withColumn("_chunk", F.floor(F.col("t") / chunk))
    lasts = versions.groupBy("series_id", F.floor(F.col("from_t") / chunk).alias("_from")).agg(F.max_by("version", "from_t").alias("version"))
    # the chunks from the next on for which the last version of a chunk is the start
    until = F.lead("_from").over(Window.partitionBy("series_id").orderBy("_from"))
    ends = rows.groupBy("series_id").agg(F.floor(F.max("t") / chunk).alias("_end"))
    starts = lasts.withColumn("_until", until).join(ends, "series_id").withColumn("_until", F.least("_until", "_end")).where(F.col("_until") > F.col("_from"))
    starts = starts.select("series_id", F.explode(F.sequence(F.col("_from") + 1, "_until")).alias("_chunk"), (F.col("_chunk") * chunk).alias("t"), "version", F.lit(-1).alias("is_row"))
    over = Window.partitionBy("series_id", "_chunk").orderBy("t", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(starts).withColumn("version", F.last("version", ignorenulls=True).over(over)).where("is_row = 1").drop("is_row", "_chunk")


#: Rows of an artificial anomaly, how many of them rise, and how far it lies ahead and from the end.
ANOMALY, RISE, AHEAD = 20, 8, 100


def artificial_anomaly(series: DataFrame, at: int, goal: float = 10.0, seed: int = 42, channels: int | None = None) -> DataFrame:
    """(series_id, t, replacement) for 20 rows of each series around row at + 100, or around the last row that leaves
    12 + 100 after it: an error is added to each value that rises in eight noisy steps and falls in twelve.

    A rising step is normal around goal / 8 plus the local mean, with a deviation of goal / 16 plus the local one; a
    falling step takes goal / 12 and goal / 24 and counts down. Mean and deviation are those of the 20 rows. Steps are
    seeded by series, row and channel, from two uniforms. With channels, `values` is an array of so many, and so is the
    replacement.
    """
    n = series.groupBy("series_id").agg((F.max("t") + 1).alias("_n"))
    pos = F.least(F.col("_n") - (ANOMALY - RISE + AHEAD), F.lit(at + AHEAD))
    first = pos - ANOMALY // 2
    local = series.join(n, "series_id").where(F.col("t").between(first, first + ANOMALY - 1))
    value = F.array("value") if channels is None else F.col("values")
    each = local.select("series_id", "t", (F.col("t") - first).alias("_i"), F.posexplode(value).alias("ch", "x"))
    whole = Window.partitionBy("series_id", "ch")
    each = each.withColumns({"mean": F.avg("x").over(whole), "std": F.stddev_pop("x").over(whole)})
    u, v = (hash_uniform(seed + i, F.col("series_id"), F.col("t") * 1000 + F.col("ch")) for i in (0, 1))
    noise = F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * v)
    part = F.when(F.col("_i") < RISE, F.lit(goal / RISE)).otherwise(F.lit(goal / (ANOMALY - RISE)))
    step = part + F.col("mean") + noise * (part / 2 + F.col("std"))
    error = F.sum(F.when(F.col("_i") < RISE, step).otherwise(-step)).over(whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    out = each.select("series_id", "t", "ch", (F.col("x") + error).alias("r")).groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("ch", "r"))).alias("r"))
    r = F.transform("r", lambda c: c["r"])
    return out.select("series_id", "t", (r[0] if channels is None else r).alias("replacement"))


def anomalies_after(series: DataFrame, events: DataFrame, goal: float = 10.0, seed: int = 42) -> DataFrame:
    """(series_id, at, first, t, replacement): an artificial anomaly after each event (series_id, at), as artificial_anomaly
    makes it after one row, of the series as it was before any; steps are seeded by the event too. Each event is spread
    over its 20 rows and meets those, so nothing but them is read of a long series twice."""
    n = series.groupBy("series_id").agg((F.max("t") + 1).alias("_n"))
    first = F.least(F.col("_n") - (ANOMALY - RISE + AHEAD), F.col("at") + AHEAD) - ANOMALY // 2
    spread = events.join(n, "series_id").withColumn("first", first).select("series_id", "at", "first", F.explode(F.sequence("first", F.col("first") + ANOMALY - 1)).alias("t"))
    local = spread.join(series.select("series_id", "t", "value"), ["series_id", "t"]).withColumn("_i", F.col("t") - F.col("first"))
    whole = Window.partitionBy("series_id", "at")
    local = local.withColumns({"mean": F.avg("value").over(whole), "std": F.stddev_pop("value").over(whole)})
    u, v = (hash_uniform(seed + i, F.col("series_id"), F.col("at"), F.col("t") * 1000) for i in (0, 1))
    noise = F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * v)
    part = F.when(F.col("_i") < RISE, F.lit(goal / RISE)).otherwise(F.lit(goal / (ANOMALY - RISE)))
    step = part + F.col("mean") + noise * (part / 2 + F.col("std"))
    error = F.sum(F.when(F.col("_i") < RISE, step).otherwise(-step)).over(whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return local.select("series_id", "at", "first", "t", (F.col("value") + error).alias("replacement"))


def last_overlay(overlays: DataFrame) -> DataFrame:
    """(series_id, t, replacement): where overlays reach into each other, that of the last event."""
    return overlays.groupBy("series_id", "t").agg(F.max_by("replacement", "at").alias("replacement"))


def overlaid(series: DataFrame, overlay: DataFrame, value: str = "value") -> DataFrame:
    return series.join(overlay, ["series_id", "t"], "left").withColumn(value, F.coalesce("replacement", value)).drop("replacement")
