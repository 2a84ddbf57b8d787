"""The catalogue of queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import math as fm
from driftline.operators import evaluate as ev
from driftline.operators import forest, frames, held, lags, models, nets, online, registry, scores, training
from driftline.sources import series as src
from driftline.sources import store
from driftline.streaming import jobs, loop

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


E = f"WITH {src.EVENTS_SQL}"
NC = f"{E}, {frames.NC_SQL}"
D = f"WITH {src.SHIPMENTS_SQL}"


def _nc(spark: SparkSession, sf: str) -> DataFrame:
    return frames.nonconformity(src.events(spark, sf))


# sources


@query(f"{E} SELECT * FROM e")
def scan_series(spark: SparkSession, sf: str) -> DataFrame:
    return src.events(spark, sf)


@query(f"{E} SELECT series_id, CASE WHEN t < 500 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(t) AS first, max(t) AS last, round(avg(value), 6) AS mean FROM e GROUP BY ALL")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    s = src.events(spark, sf)
    train = src.train_or_prefix(s, None, 500).withColumn("part", F.lit("train"))
    parts = train.unionByName(s.where("t >= 500").withColumn("part", F.lit("test")))
    return parts.groupBy("series_id", "part").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"{D}, x AS (SELECT t, unnest([0, 1, 2, 3])::INTEGER AS ch, unnest([c0, c1, c2, c3]) AS x FROM d) SELECT 'lineitem' AS series_id, t, ch, x FROM x")
def to_long_channels(spark: SparkSession, sf: str) -> DataFrame:
    return src.to_long(src.shipments(spark, sf))


@query("SELECT unnest(['sw_mu_sig','sw_mu_sig','sw_mu_sig','sw_ks','sw_ks','sw_ks','ures_mu_sig','ures_mu_sig','ures_mu_sig','ures_ks','ures_ks','ures_ks','ares_al_mu_sig','ares_al_ks','ares_cl_mu_sig','ares_cl_ks']) AS strategy, unnest(['avg','al','cl','avg','al','cl','avg','al','cl','avg','al','cl','al','al','cl','cl']) AS score")
def approach_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return store.approaches(spark)


# representation


def _vector_sql(lag: int) -> str:
    return f"""{E}, v AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {9 + lag} PRECEDING AND {lag} PRECEDING) AS fv FROM e)
SELECT series_id, t, len(fv)::INTEGER AS length, fv[1] AS first, fv[-1] AS last, round(list_sum(fv), 6) AS total FROM v WHERE len(fv) = 10"""


def _vector_stats(v: DataFrame) -> DataFrame:
    total = F.aggregate("fv", F.lit(0.0), lambda s, x: s + x)
    return v.select("series_id", "t", F.size("fv").alias("length"), F.get("fv", F.lit(0)).alias("first"), F.element_at("fv", -1).alias("last"), F.round(total, 6).alias("total"))


@query(_vector_sql(0))
def feature_vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_stats(frames.feature_vectors(src.events(spark, sf), 10))


@query(_vector_sql(1))
def feature_vector_lagged(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_stats(frames.feature_vectors(src.events(spark, sf), 10, lag=1))


@query(f"{_vector_sql(0)} AND t > (SELECT max(t) FROM e f WHERE f.series_id = v.series_id) - 100")
def training_windows_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_stats(frames.last_windows(frames.feature_vectors(src.events(spark, sf), 10), 100))


# forecasts and nonconformity


def _difference_query(d: int) -> None:
    terms = " + ".join(f"{c!r}::DOUBLE * lag(value, {k}) OVER w" for k, c in enumerate(fm.difference_factors(d), 1))
    sql = f"""{E}, p AS (SELECT series_id, t, value, {terms} AS pred FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, round(pred, 6) AS pred, round(abs(value - pred), 6) AS error FROM p WHERE pred IS NOT NULL"""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = frames.difference_forecast(src.events(spark, sf), d).where("pred is not null")
        return f.select("series_id", "t", r6("pred"), F.round(F.abs(F.col("value") - F.col("pred")), 6).alias("error"))

    run.__name__ = f"diff_factors_forecast_d{d}"
    query(sql)(run)


for _d in (1, 2, 3):
    _difference_query(_d)

MEAN_SQL = f"""{E}, v AS (SELECT series_id, t, list(value) OVER w AS fv, avg(value) OVER w AS mean FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS 9 PRECEDING))"""


def _against_mean(spark: SparkSession, sf: str, measure) -> DataFrame:
    """Vectors of 10 against their own mean in every place."""
    s = src.events(spark, sf)
    over = lambda w: w.rowsBetween(-9, 0)
    v = frames.rolling(s, 9, {"fv": lambda w: F.collect_list("value").over(over(w)), "mean": lambda w: F.avg("value").over(over(w))}).where(F.size("fv") == 10)
    return v.select("series_id", "t", F.round(measure(F.col("fv"), F.transform("fv", lambda _: F.col("mean"))), 6).alias("nc"))


@query(f"{MEAN_SQL} SELECT series_id, t, round(sqrt(list_sum(list_transform(fv, lambda x: (x - mean) * (x - mean)))), 6) AS nc FROM v WHERE len(fv) = 10")
def nc_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return _against_mean(spark, sf, fm.euclidean)


@query(f"{MEAN_SQL} SELECT series_id, t, round(list_sum(list_transform(fv, lambda x: abs(x - mean))) / 10, 6) AS nc FROM v WHERE len(fv) = 10")
def nc_mean_abs_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _against_mean(spark, sf, fm.mean_abs_diff)


@query(f"{MEAN_SQL} SELECT series_id, t, round(1 - list_sum(list_transform(fv, lambda x: x * mean)) / nullif(sqrt(list_sum(list_transform(fv, lambda x: x * x))) * sqrt(10 * mean * mean), 0), 6) AS nc FROM v WHERE len(fv) = 10")
def nc_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _against_mean(spark, sf, fm.cosine_distance)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY label, i)
SELECT vec_id, label, round(1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) AS nc FROM x JOIN c USING (label, i) GROUP BY vec_id, label""")
def nc_embedding_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine distance of each vector to the mean of its label, one row a label and place for the means."""
    v = src.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    return v.join(centre, "label").select("vec_id", "label", F.round(fm.cosine_distance(F.col("v"), F.col("centre")), 6).alias("nc"))


@query(f"""{NC}, b AS (SELECT *, (t - 100) // 50 AS batch_id FROM n WHERE t >= 100),
m AS (SELECT *, greatest(1.0::DOUBLE, max(nc) OVER (PARTITION BY series_id ORDER BY batch_id RANGE UNBOUNDED PRECEDING)) AS running_max FROM b)
SELECT series_id, t, batch_id, round(running_max, 6) AS running_max, round(nc / running_max, 6) AS normalised FROM m""")
def nc_running_max_norm(spark: SparkSession, sf: str) -> DataFrame:
    return frames.running_max_normalised(_nc(spark, sf)).select("series_id", "t", "batch_id", r6("running_max"), r6("normalised"))


# anomaly scores


@query(f"{NC}, s AS (SELECT series_id, t, avg(nc) OVER (PARTITION BY series_id ORDER BY t ROWS 49 PRECEDING) AS score FROM n) SELECT series_id, t, round(score, 6) AS score FROM s WHERE t >= 49")
def score_average_of_window(spark: SparkSession, sf: str) -> DataFrame:
    return scores.average_of_window(src.events(spark, sf)).select("series_id", "t", r6("score"))


@query(f"{E}, {scores.likelihood_sql()} SELECT series_id, t, round(score, 6) AS score FROM a")
def score_anomaly_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return scores.anomaly_likelihood(src.events(spark, sf)).select("series_id", "t", r6("score"))


@query(f"{E}, {scores.likelihood_of_batches_sql()}")
def score_anomaly_likelihood_batchsq(spark: SparkSession, sf: str) -> DataFrame:
    return scores.likelihood_of_batches(_nc(spark, sf)).select("series_id", "t", r6("score"))


@query(f"{E}, {scores.likelihood_what_if_sql()}")
def score_likelihood_whatif(spark: SparkSession, sf: str) -> DataFrame:
    return scores.likelihood_what_if(_nc(spark, sf)).select("series_id", "t", r6("score"))


CONFIDENCE_SQL = f"""{NC}, c AS (SELECT series_id, t, nc, list(nc) OVER (PARTITION BY series_id ORDER BY t ROWS 49 PRECEDING) AS w FROM n),
f AS (SELECT series_id, t, len(list_filter(w, lambda x: x >= nc)) / 50.0::DOUBLE AS confidence FROM c WHERE t >= 49)"""


@query(f"{CONFIDENCE_SQL} SELECT series_id, t, round(confidence, 6) AS confidence FROM f")
def confidence_level_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return scores.confidence(_nc(spark, sf)).select("series_id", "t", r6("confidence"))


@query(f"""{CONFIDENCE_SQL}, w AS (SELECT series_id, t, list(confidence) OVER (PARTITION BY series_id ORDER BY t ROWS 99 PRECEDING) AS c FROM f),
u AS (SELECT series_id, t, list_sort(list_distinct(c)) AS c FROM w WHERE len(c) = 100 AND (t - 49 + 1) % 50 = 0),
x AS (SELECT series_id, t, len(c) AS n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM u)
SELECT series_id, t, n, round(max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)), 6) AS d FROM x GROUP BY ALL""")
def ks_uniform_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return scores.uniform_statistic(scores.confidence(_nc(spark, sf))).select("series_id", "t", "n", r6("d"))


P_OF_F = f"""w AS (SELECT series_id, t, list(confidence) OVER (PARTITION BY series_id ORDER BY t ROWS 99 PRECEDING) AS c FROM f),
u AS (SELECT series_id, t, list_sort(list_distinct(c)) AS c FROM w WHERE len(c) = 100), x AS (SELECT series_id, t, len(c) AS n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM u),
ks AS (SELECT series_id, t, n, max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)) AS d FROM x GROUP BY ALL), pp AS (SELECT DISTINCT n, d FROM ks WHERE n > 30), {fm.uniform_p_value_sql("pp")}"""
P_SQL = f"""{CONFIDENCE_SQL.replace("WITH", "WITH RECURSIVE", 1)}, {P_OF_F}"""
UNIFIED = f"pt AS (SELECT series_id, t, p FROM ks JOIN pv ON pv.n = ks.n AND pv.d = ks.d), {scores.unified_sql()}"


def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    return scores.p_values(store.written(scores.uniform_statistic(scores.confidence(_nc(spark, sf)), every=1)))


@query(f"""{P_SQL} SELECT 'diff' AS model, 'sw_ks' AS strategy, 'cl' AS score_kind, 'run1' AS run, f.series_id, f.t, round(confidence, 6) AS confidence, round(p, 9) AS p_value
FROM f LEFT JOIN ks ON ks.series_id = f.series_id AND ks.t = f.t LEFT JOIN pv ON pv.n = ks.n AND pv.d = ks.d""")
def p_value_files(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence levels and p-values, each written as files of their approach and read again; rows whose window has too
    few distinct levels have no p-value."""
    path = f"{store.shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    store.write_scores(scores.confidence(_nc(spark, sf)).select("series_id", "t", "confidence"), f"{path}/{store.LEVELS}", "diff", "sw_ks", "cl", "run1")
    store.write_scores(_p_values(spark, sf).where("p_value is not null").select("series_id", "t", "p_value"), f"{path}/{store.P_VALUES}", "diff", "sw_ks", "cl", "run1")
    keys = ["series_id", "model", "strategy", "score_kind", "run"]
    read = lambda name, column: store.read_scores(spark, f"{path}/{name}", schema=f"t long, {column} double")
    both = read(store.LEVELS, "confidence").join(read(store.P_VALUES, "p_value"), [*keys, "t"], "left")
    return both.select(*keys, "t", r6("confidence"), F.round("p_value", 9).alias("p_value"))


@query(f"{P_SQL}, {UNIFIED}")
def unified_scores(spark: SparkSession, sf: str) -> DataFrame:
    """p-values of whole series on a common scale, which large ones stretch for all that follow."""
    return scores.unified(_p_values(spark, sf)).select("series_id", "t", F.round("p_value", 9).alias("p_value"), r6("scale"), r6("score"))


# training sets

SCORED = f"{E}, {scores.likelihood_sql()}".replace("AS score FROM z", "AS raw FROM z").replace("a AS (SELECT series_id", "a0 AS (SELECT series_id") + ", a AS (SELECT series_id, t, value, is_anomaly, nc, round(raw, 6) AS score FROM a0)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scores.anomaly_likelihood(_nc(spark, sf)).withColumn("score", F.round("score", 6))


U_SQL = fm.hash_uniform_sql(42, "series_id", "t")


@query(f"{E}, u AS (SELECT series_id, t, {U_SQL} AS u FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY u, t)::INTEGER AS slot FROM u) SELECT series_id, t, round(u, 9) AS u, slot FROM r WHERE slot <= 100")
def reservoir_uniform_topn(spark: SparkSession, sf: str) -> DataFrame:
    return training.uniform_reservoir(src.events(spark, sf), 100).select("series_id", "t", F.round("u", 9).alias("u"), "slot")


@query(f"""{E}, {training.reservoir_writes_sql(100, 20)}, u AS (SELECT *, lead(from_t) OVER (PARTITION BY series_id, slot ORDER BY from_t) AS until_t FROM wr),
c AS (SELECT series_id, t, value, unnest(range(0, n, 50)) AS upto, from_t, least(coalesce(until_t, n), n) AS until_t FROM u)
SELECT series_id, upto, count(*) AS n, min(t) AS first, max(t) AS last, sum(t)::BIGINT AS places, round(sum(value), 4) AS total FROM c WHERE upto >= from_t AND upto < until_t GROUP BY ALL""")
def reservoir_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """What a uniform reservoir of 100 rows, fed by batches of 20, holds at every fiftieth row."""
    e = src.events(spark, sf)
    held = training.reservoir_at(training.reservoir_writes(e, 100, 20), 50, e.groupBy("series_id").agg((F.max("t") + 1).alias("n")))
    held = held.join(e.select("series_id", "t", "value"), ["series_id", "t"])
    return held.groupBy("series_id", F.col("at").alias("upto")).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("t").alias("places"), F.round(F.sum("value"), 4).alias("total"))


PRIORITY_SQL = f"{SCORED}, p AS (SELECT series_id, t, score, round(pow(0.7::DOUBLE + 0.2::DOUBLE * {U_SQL}, 3.0::DOUBLE / exp(-3.0::DOUBLE * score)), 9) AS priority FROM a)"


@query(f"{PRIORITY_SQL} SELECT series_id, t, priority FROM p")
def priority_values(spark: SparkSession, sf: str) -> DataFrame:
    u = fm.hash_uniform(42, F.col("series_id"), F.col("t"))
    return _scored(spark, sf).select("series_id", "t", F.round(training.priority(F.col("score"), u), 9).alias("priority"))


@query(f"{PRIORITY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY priority DESC, t)::INTEGER AS slot FROM p) SELECT series_id, t, priority, slot FROM r WHERE slot <= 100")
def reservoir_priority_topn(spark: SparkSession, sf: str) -> DataFrame:
    return training.priority_reservoir(_scored(spark, sf), 100).select("series_id", "t", "priority", "slot")


AWARE_SQL = f"{PRIORITY_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, {held.aware_writes_sql(100, 20)}"


@query(f"{AWARE_SQL} SELECT series_id, t, priority, from_t, coalesce(until_t, -1) AS until_t FROM aw")
def aware_reservoir_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """What a score-aware reservoir of 100 rows, fed by batches of 20 and their likelihoods, holds from when to when."""
    return held.aware_writes(_scored(spark, sf), 100, 20).withColumn("until_t", F.coalesce("until_t", F.lit(-1).cast("long")))


@query(f"""{NC}, {training.reservoir_writes_sql(100, 20)}, uw AS (SELECT *, lead(from_t) OVER (PARTITION BY series_id, slot ORDER BY from_t) AS until_t FROM wr),
{held.confidence_of_held_sql("uw", 100, "cu")} SELECT series_id, t, round(confidence, 6) AS confidence FROM cu""")
def confidence_uniform_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence levels by what a uniform reservoir holds when a row comes."""
    nc = _nc(spark, sf)
    return held.confidence_of_held(nc, training.reservoir_writes(nc, 100, 20), 100).select("series_id", "t", r6("confidence"))


@query(f"""{AWARE_SQL}, {held.confidence_of_held_sql("aw", 100)}, {P_OF_F}, {UNIFIED}""")
def confidence_aware_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: likelihoods fill a score-aware reservoir, confidence levels follow what it holds, their windows
    are tested for being uniform, and the p-values go on a common scale."""
    nc = store.written(_nc(spark, sf))  # read by five jobs
    scored = store.written(scores.anomaly_likelihood(nc).select("series_id", "t", F.round("score", 6).alias("score")))
    levels = held.confidence_of_held(nc, held.aware_writes(scored, 100, 20), 100)
    p = scores.p_values(store.written(scores.uniform_statistic(levels.select("series_id", "t", "confidence"), every=1, first=100)))
    return scores.unified(p).select("series_id", "t", F.round("p_value", 9).alias("p_value"), r6("scale"), r6("score"))


#: The series of vectors of ten values, each named by its last one.
VECTOR_SERIES = f"""WITH RECURSIVE {src.EVENTS_SQL.replace("e AS", "ew AS", 1)}, ev AS (SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS 9 PRECEDING) AS fv FROM ew),
e AS (SELECT series_id, t - 9 AS t, value, is_anomaly, fv FROM ev WHERE t >= 9)"""
DRIFTED = "SELECT series_id, upto, nth, round(d, 6) AS d, round(mu_shift, 6) AS mu_shift, round(sigma, 6) AS sigma, round(sigma0, 6) AS sigma0, drift, version FROM dr WHERE i > 0"


def _vector_series(spark: SparkSession, sf: str) -> DataFrame:
    v = frames.feature_vectors(src.events(spark, sf), 10)
    return v.select("series_id", (F.col("t") - 9).alias("t"), "value", F.array("fv").alias("fv"))


def _drifted(checks: DataFrame) -> DataFrame:
    return checks.select("series_id", "upto", "nth", *[r6(c) for c in ("d", "mu_shift", "sigma", "sigma0")], "drift", "version")


@query(f"""{VECTOR_SERIES}, {training.reservoir_writes_sql(100, 20)}, uw AS (SELECT *, lead(from_t) OVER (PARTITION BY series_id, slot ORDER BY from_t) AS until_t FROM wr),
{held.drift_of_held_sql("uw", 100, 3)} {DRIFTED}""")
def drift_uniform_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """Every third change of a uniform reservoir of vectors is tested for drift since the last one, by Kolmogorov-Smirnov."""
    v = _vector_series(spark, sf)
    return _drifted(held.drift_of_held(v, training.reservoir_writes(v, 100, 20), 100, 3))


@query(f"""{VECTOR_SERIES}, {PRIORITY_SQL.removeprefix(f"WITH {src.EVENTS_SQL}, ")}, {held.aware_writes_sql(100, 20)}, {held.drift_of_held_sql("aw", 100, 5, "mu_sigma")} {DRIFTED}""")
def drift_aware_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth change of a score-aware reservoir of vectors is tested for drift, by mean and deviation."""
    v = _vector_series(spark, sf)
    scored = scores.anomaly_likelihood(frames.nonconformity(v.select("series_id", "t", "value"))).withColumn("score", F.round("score", 6))
    return _drifted(held.drift_of_held(v, held.aware_writes(scored, 100, 20), 100, 5, "mu_sigma"))


@query(f"{E}, {training.mu_sigma_sql()} SELECT series_id, t, round(mu_shift, 6) AS mu_shift, round(sigma, 6) AS sigma, round(sigma0, 6) AS sigma0 FROM s")
def musigma_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return training.mu_sigma(src.events(spark, sf)).select("series_id", "t", r6("mu_shift"), r6("sigma"), r6("sigma0"))


CHANNELS = f"{D}, e AS (SELECT t, unnest([0, 1, 2, 3]) AS series_id, unnest([c0, c1, c2, c3]) AS value FROM d), {training.mu_sigma_sql()}"


@query(f"""{CHANNELS}, y AS (SELECT t, sqrt(sum(mu_shift * mu_shift)) AS shift, sqrt(sum(sigma * sigma)) AS sigma, sqrt(sum(sigma0 * sigma0)) AS sigma0 FROM s GROUP BY t)
SELECT 'lineitem' AS series_id, t, round(shift, 3) AS mu_shift, round(sigma, 3) AS sigma, round(sigma0, 3) AS sigma0, shift > sigma0 OR sigma < sigma0 / 2 OR sigma > sigma0 * 2 AS drift FROM y""")
def musigma_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Drift of training sets of vectors of ten rows and four channels, over all their cells."""
    checks = training.mu_sigma_drift(training.mu_sigma_channels(src.shipments(spark, sf)))
    return checks.select("series_id", "t", *[F.round(c, 3).alias(c) for c in ("mu_shift", "sigma", "sigma0")], "drift")


@query(f"{E}, {training.mu_sigma_sql(20, 5, 10)} SELECT series_id, t, mu_shift > sigma0 OR sigma < sigma0 / 2 OR sigma > sigma0 * 2 AS drift FROM s")
def musigma_drift_flags(spark: SparkSession, sf: str) -> DataFrame:
    return training.mu_sigma_drift(training.mu_sigma(src.events(spark, sf), 20, 5, 10)).select("series_id", "t", "drift")


KS_SQL = f"""{D}, x AS (SELECT year(day)::INTEGER AS year, (month(day) > 6)::INTEGER AS side, unnest([0, 1, 2, 3])::INTEGER AS ch, unnest([c0, c1, c2, c3]) AS x FROM d),
n AS (SELECT year, ch, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM x GROUP BY ALL),
f AS (SELECT year, ch, sum(1 - side) OVER w AS fa, sum(side) OVER w AS fb FROM x WINDOW w AS (PARTITION BY year, ch ORDER BY x RANGE UNBOUNDED PRECEDING)),
k AS (SELECT year, ch, n1, n2, max(abs(fa / n1 - fb / n2)) AS d FROM f JOIN n USING (year, ch) GROUP BY ALL)"""


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    s = src.shipments(spark, sf)
    return s.select(F.year("day").alias("year"), (F.month("day") > 6).cast("int").alias("side"), F.posexplode("values").alias("ch", "x"))


@query(f"{KS_SQL} SELECT year, ch, n1::BIGINT AS n1, n2::BIGINT AS n2, round(d, 6) AS d FROM k")
def ks_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    return training.ks_two_sample(_halves(spark, sf), ["year", "ch"]).select("year", "ch", "n1", "n2", r6("d"))


@query(f"{KS_SQL} SELECT year, bool_or(d > sqrt(2.0::DOUBLE / n1 * {math.log(40)!r}::DOUBLE)) AS drift FROM k GROUP BY year")
def ks_two_sample_drift(spark: SparkSession, sf: str) -> DataFrame:
    k = training.ks_two_sample(_halves(spark, sf), ["year", "ch"])
    return k.groupBy("year").agg(F.bool_or(F.col("d") > training.ks_bound(F.col("n1"))).alias("drift"))


@query(f"""{E}, w AS (SELECT series_id, t, value AS x, CASE WHEN t < 109 THEN 0 ELSE 1 END AS side, t % 109 AS i FROM e WHERE t < 218),
m AS (SELECT *, least(i + 1, 10, 100, 109 - i) AS m FROM w), n AS (SELECT series_id, side, sum(m) AS n FROM m GROUP BY ALL),
f AS (SELECT m.series_id, sum(m) FILTER (side = 0) OVER o AS fa, sum(m) FILTER (side = 1) OVER o AS fb FROM m WINDOW o AS (PARTITION BY series_id ORDER BY x RANGE UNBOUNDED PRECEDING))
SELECT f.series_id, round(max(abs(coalesce(fa, 0) / a.n - coalesce(fb, 0) / b.n)), 6) AS d FROM f JOIN n a ON a.series_id = f.series_id AND a.side = 0 JOIN n b ON b.series_id = f.series_id AND b.side = 1 GROUP BY ALL""")
def ks_training_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Two training sets of 100 vectors of 10 rows: each row counts as often as vectors hold it, and no vector is built."""
    s = src.events(spark, sf).where("t < 218").withColumns({"side": (F.col("t") >= 109).cast("int"), "i": F.pmod(F.col("t"), F.lit(109))})
    d = training.ks_two_sample(s, ["series_id"], value="value", weight=training.vector_multiplicity(F.col("i"), 10, 100))
    return d.select("series_id", r6("d"))


@query(f"{E}, f AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) AS no FROM e WHERE is_anomaly = 1) SELECT series_id, t, no::INTEGER AS no FROM f WHERE no % 10 = 0")
def drift_every_k(spark: SparkSession, sf: str) -> DataFrame:
    return training.every_k(src.events(spark, sf).withColumn("flag", F.col("is_anomaly") == 1), 10).select("series_id", "t", "no")


@query(f"""{E}, {training.mu_sigma_sql(20, 5, 10)}, v AS (SELECT series_id, t AS from_t, row_number() OVER (PARTITION BY series_id ORDER BY t) AS version FROM s WHERE mu_shift > sigma0 OR sigma < sigma0 / 2 OR sigma > sigma0 * 2)
SELECT series_id, t, coalesce((SELECT max(version) FROM v WHERE v.series_id = e.series_id AND v.from_t <= e.t), 0)::INTEGER AS version FROM e""")
def model_version_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = store.written(src.events(spark, sf))
    drift = store.written(training.mu_sigma_drift(training.mu_sigma(e, 20, 5, 10)).where("drift").select("series_id", "t"))
    versions = src.numbered(drift, "series_id", ["t"], F.floor(F.col("t") / frames.CHUNK), "version")
    out = training.versions_asof(e, versions.select("series_id", F.col("t").alias("from_t"), (F.col("version") + 1).cast("int").alias("version")))
    return out.select("series_id", "t", F.coalesce("version", F.lit(0)).alias("version"))


# evaluation

ALL = f"WITH {src.ALL_EVENTS_SQL}, a AS (SELECT * FROM e), {ev.SEQUENCES_SQL}"


@query(f"{ALL} SELECT series_id, k, s, e FROM k")
def anomaly_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return ev.sequences(src.all_events(spark, sf))


EVAL = f"{SCORED}, {ev.SEQUENCES_SQL}, {ev.DETECTIONS_SQL}"


@query(f"{EVAL} SELECT * FROM p WHERE lv IN (25, 50, 75)")
def anomaly_sequences_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.detections(_scored(spark, sf), [25, 50, 75])


def _at_60(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = store.written(_scored(spark, sf))
    return store.written(ev.detections(s, [60])), store.written(ev.sequences(s))


TOUCH = "p.series_id = k.series_id AND p.s <= k.e AND k.s <= p.e"


@query(f"{EVAL} SELECT p.series_id, p.s, p.e, k.k AS k2 FROM p JOIN k ON {TOUCH} WHERE lv = 60")
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    found, true = _at_60(spark, sf)
    return ev.overlaps(found, true).select("series_id", "s", "e", "k2")


@query(f"{EVAL} SELECT k.* FROM k WHERE EXISTS (SELECT 1 FROM p WHERE lv = 60 AND {TOUCH})")
def detected_true_semi(spark: SparkSession, sf: str) -> DataFrame:
    found, true = _at_60(spark, sf)
    hit = ev.overlaps(found, true).select("series_id", F.col("k2").alias("k")).distinct()
    return true.join(hit, ["series_id", "k"], "left_semi")


@query(f"{EVAL} SELECT series_id, s, e FROM p WHERE lv = 60 AND NOT EXISTS (SELECT 1 FROM k WHERE {TOUCH})")
def false_alarm_anti(spark: SparkSession, sf: str) -> DataFrame:
    found, true = _at_60(spark, sf)
    hit = ev.overlaps(found, true).select("series_id", "s", "e").distinct()
    return found.join(hit, ["series_id", "s", "e"], "left_anti").select("series_id", "s", "e")


COUNT_SQL = f"""{EVAL}, t AS (SELECT series_id, count(*) AS n FROM k GROUP BY series_id), g AS (SELECT p.series_id, lv, p.s, p.e, min(k.k) AS goal FROM p LEFT JOIN k ON {TOUCH} GROUP BY ALL),
c AS (SELECT series_id, lv, count(DISTINCT goal) AS tp, count(*) FILTER (goal IS NULL) AS fp FROM g GROUP BY ALL),
h AS (SELECT t.series_id, lv.lv, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, n - coalesce(tp, 0) AS fn FROM t CROSS JOIN lv LEFT JOIN c ON c.series_id = t.series_id AND c.lv = lv.lv),
q AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM h)"""
AREA_SQL = """, w AS (SELECT *, (precision + lag(precision) OVER o) * (recall - lag(recall) OVER o) AS step FROM q WINDOW o AS (PARTITION BY series_id ORDER BY recall, lv))"""


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    s = store.written(_scored(spark, sf))
    return ev.precision_recall(ev.counts(ev.detections(s), store.written(ev.sequences(s))))


@query(f"{COUNT_SQL} SELECT series_id, lv, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM q")
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(spark, sf).select("series_id", "lv", "tp", "fp", "fn", r6("precision"), r6("recall"))


@query(f"{COUNT_SQL}{AREA_SQL} SELECT series_id, round(coalesce(sum(step), 0) / 2, 6) AS area FROM w GROUP BY series_id")
def pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.area(_curve(spark, sf), ["series_id"]).select("series_id", r6("area"))


@query(f"{COUNT_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(precision * precision + recall * recall, 9) DESC, lv) AS o FROM q) SELECT series_id, lv AS best FROM b WHERE o = 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.area(_curve(spark, sf), ["series_id"]).select("series_id", "best")


VOLUME_SQL = """, w AS (SELECT *, (precision + lag(precision) OVER o) * (recall - lag(recall) OVER o) AS step FROM q WINDOW o AS (PARTITION BY series_id, buffer ORDER BY recall, lv)),
ar AS (SELECT series_id, buffer, coalesce(sum(step), 0) AS area FROM w GROUP BY ALL),
vo AS (SELECT series_id, (area + lag(area) OVER o) * (buffer - lag(buffer) OVER o) / 200.0::DOUBLE AS part FROM ar WINDOW o AS (PARTITION BY series_id ORDER BY buffer))
SELECT series_id, round(sum(part) / 4, 6) AS vus FROM vo GROUP BY series_id"""


@query(f"""{EVAL}, bu AS (SELECT unnest(range(0, 201, 20))::INTEGER AS buffer), en AS (SELECT series_id, max(t) AS last, min(t) AS first FROM a GROUP BY series_id),
kb AS (SELECT k.series_id, buffer, k, greatest(s - buffer // 2, first) AS s, least(e + buffer // 2, last) AS e FROM k CROSS JOIN bu JOIN en ON en.series_id = k.series_id),
g AS (SELECT p.series_id, bu.buffer, lv, p.s, p.e, min(kb.k) AS goal FROM p CROSS JOIN bu LEFT JOIN kb ON kb.series_id = p.series_id AND kb.buffer = bu.buffer AND p.s <= kb.e AND kb.s <= p.e GROUP BY ALL),
c AS (SELECT series_id, buffer, lv, count(DISTINCT goal) AS tp, count(*) FILTER (goal IS NULL) AS fp FROM g GROUP BY ALL),
t AS (SELECT series_id, buffer, count(*) AS n FROM kb GROUP BY ALL),
h AS (SELECT t.series_id, t.buffer, lv.lv, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, n - coalesce(tp, 0) AS fn FROM t CROSS JOIN lv LEFT JOIN c ON c.series_id = t.series_id AND c.buffer = t.buffer AND c.lv = lv.lv),
q AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM h){VOLUME_SQL}""")
def pr_vus_buffered(spark: SparkSession, sf: str) -> DataFrame:
    s = store.written(_scored(spark, sf))
    curve = ev.precision_recall(ev.counts_buffered(ev.detections(s), store.written(ev.sequences(s))))
    return ev.volume(ev.area(curve, ["series_id", "buffer"], 1.0)).select("series_id", r6("vus"))


SOFT = f"{EVAL}, {ev.SOFT_SQL}"


SOFT_CURVE_SQL = """pl AS (SELECT series_id, buffer, floor(round(sum(y + soft) / 2, 9)) AS pl FROM y GROUP BY ALL),
tp AS (SELECT series_id, buffer, lv.lv, sum(soft) AS tp, count(*) AS al FROM y JOIN lv ON score > lv.lv * 0.01::DOUBLE GROUP BY ALL),
pk AS (SELECT k.series_id, k.k, max(score) AS peak FROM k JOIN a ON a.series_id = k.series_id AND a.t BETWEEN k.s AND k.e GROUP BY ALL),
ex AS (SELECT series_id, lv, avg((peak > lv * 0.01::DOUBLE)::INTEGER) AS existence FROM pk CROSS JOIN lv GROUP BY ALL),
q AS (SELECT pl.series_id, pl.buffer, ex.lv, round(coalesce(tp, 0) / greatest(coalesce(al, 0), 1), 9) AS precision, round(coalesce(tp, 0) / greatest(pl, 1) * existence, 9) AS recall
  FROM pl JOIN ex USING (series_id) LEFT JOIN tp ON tp.series_id = pl.series_id AND tp.buffer = pl.buffer AND tp.lv = ex.lv)"""


@query(f"{SOFT}, {SOFT_CURVE_SQL}{VOLUME_SQL}")
def pr_vus_soft(spark: SparkSession, sf: str) -> DataFrame:
    s = store.written(_scored(spark, sf))
    true = store.written(ev.sequences(s))
    curve = ev.soft_curve(ev.soft_labels(s, true), s, true)
    return ev.volume(ev.area(curve, ["series_id", "buffer"], 1.0)).select("series_id", r6("vus"))


@query(f"""{SOFT} SELECT series_id, round(sum(soft) FILTER (score > 0.5), 4) AS tp, round(sum(1 - soft) FILTER (score > 0.5), 4) AS fp, round(sum(soft) FILTER (score <= 0.5), 4) AS fn,
round(sum(1 - soft) FILTER (score <= 0.5), 4) AS tn FROM y WHERE buffer = 100 GROUP BY series_id""")
def confusion_soft(spark: SparkSession, sf: str) -> DataFrame:
    s = store.written(_scored(spark, sf))
    soft = ev.soft_labels(s, ev.sequences(s)).where("buffer = 100")
    total = lambda c, hit, name: F.round(F.sum(F.when(hit, c)), 4).alias(name)
    hit = F.col("score") > 0.5
    return soft.groupBy("series_id").agg(total(F.col("soft"), hit, "tp"), total(1 - F.col("soft"), hit, "fp"), total(F.col("soft"), ~hit, "fn"), total(1 - F.col("soft"), ~hit, "tn"))


NAB_SQL = f"""WITH {src.ALL_EVENTS_SQL}, {scores.likelihood_sql()}"""
NAB_SQL = NAB_SQL.replace("AS score FROM z", "AS raw FROM z").replace("a AS (SELECT series_id", "a0 AS (SELECT series_id") + f""", a AS (SELECT series_id, t, is_anomaly, round(raw, 6) AS score FROM a0), {ev.SEQUENCES_SQL},
la AS (SELECT max(t) AS last FROM a), i AS (SELECT series_id, k, s, e - s AS len, unnest(range(0, 2 * (e - s))) AS i FROM k WHERE e > s),
m AS (SELECT series_id, least(s + i, last) AS t, arg_max(2.0::DOUBLE / (1.0 + exp(5.0::DOUBLE * (3.0::DOUBLE * i / len - 3))) - 1, k * 1000000 + i) AS r FROM i CROSS JOIN la GROUP BY ALL),
w AS (SELECT a.series_id, a.t, a.score, coalesce(m.r, -1.0::DOUBLE) AS reward, k.k AS seq FROM a LEFT JOIN m ON m.t = a.t LEFT JOIN k ON a.t BETWEEN k.s AND k.e)"""


def _nab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = store.written(scores.anomaly_likelihood(frames.nonconformity(src.all_events(spark, sf))).withColumn("score", F.round("score", 6)))
    true = store.written(ev.sequences(s))
    return store.written(ev.nab_rewards(s, true)), true


@query(f"{NAB_SQL} SELECT series_id, t, round(reward, 6) AS reward, coalesce(seq, -1) AS seq FROM w")
def nab_reward_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _nab(spark, sf)[0].select("series_id", "t", r6("reward"), F.coalesce("seq", F.lit(-1)).alias("seq"))


@query(f"""{NAB_SQL}, lv AS (SELECT unnest(range(100))::INTEGER AS lv), o AS (SELECT lv, sum(reward) AS r FROM w JOIN lv ON seq IS NULL AND score > lv.lv * 0.01::DOUBLE GROUP BY lv),
f AS (SELECT lv, seq, arg_min(reward, t) AS r FROM w JOIN lv ON seq IS NOT NULL AND reward > 0 AND score > lv.lv * 0.01::DOUBLE GROUP BY ALL),
x AS (SELECT lv, sum(r) AS r FROM (SELECT * FROM o UNION ALL SELECT lv, r FROM f) GROUP BY lv)
SELECT 'all' AS series_id, lv.lv, round(coalesce(r, 0.0::DOUBLE) / (SELECT count(*) FROM k), 6) AS nab FROM lv LEFT JOIN x ON x.lv = lv.lv""")
def nab_score(spark: SparkSession, sf: str) -> DataFrame:
    return ev.nab_scores(*_nab(spark, sf))


COMPARE_SQL = f"""{E}, p AS (SELECT series_id, t, abs(value - lag(value) OVER w) AS nc1, abs(value - 2.0::DOUBLE * lag(value) OVER w + lag(value, 2) OVER w) AS nc2 FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t)),
l AS (SELECT series_id, t, unnest(['d1', 'd2']) AS version, unnest([nc1, nc2]) AS nc FROM p WHERE nc2 IS NOT NULL)"""


@query(f"""{COMPARE_SQL}, m AS (SELECT series_id, version, avg(nc) FILTER (t < 100) AS mean, stddev_pop(nc) FILTER (t < 100) AS sd, max(nc) FILTER (t BETWEEN 100 AND 169) AS top, arg_max(t, nc) FILTER (t BETWEEN 100 AND 169) AS at_top FROM l GROUP BY ALL)
SELECT series_id, version, round(mean, 6) AS mean, round(sd, 6) AS sd, round(top, 6) AS top, at_top, round(top - mean, 6) AS diff FROM m""")
def experiment_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two forecasters before and around rows 100 to 119: means before, largest score up to 50 rows after."""
    e = src.events(spark, sf)
    each = [frames.difference_forecast(e, d).select("series_id", "t", F.lit(f"d{d}").alias("version"), F.abs(F.col("value") - F.col("pred")).alias("nc")).where("t >= 2") for d in (1, 2)]
    both = each[0].unionByName(each[1])
    before, around = F.col("t") < 100, F.col("t").between(100, 169)
    m = both.groupBy("series_id", "version").agg(F.avg(F.when(before, F.col("nc"))).alias("mean"), F.stddev_pop(F.when(before, F.col("nc"))).alias("sd"), F.max(F.when(around, F.col("nc"))).alias("top"), F.max_by("t", F.when(around, F.col("nc"))).alias("at_top"))
    return m.select("series_id", "version", r6("mean"), r6("sd"), r6("top"), "at_top", F.round(F.col("top") - F.col("mean"), 6).alias("diff"))


@query(f"""{COMPARE_SQL}, a AS (SELECT series_id, version, 'avg' AS score, avg(nc) OVER (PARTITION BY series_id, version ORDER BY t ROWS 49 PRECEDING) AS v, t FROM l),
x AS (SELECT series_id, version, score, avg(v) AS v FROM a WHERE t >= 60 GROUP BY ALL UNION ALL SELECT series_id, version, 'raw', avg(nc) FROM l WHERE t >= 60 GROUP BY ALL)
SELECT version AS model, score, series_id, round(avg(v), 6) AS mean, grouping(version, score, series_id)::BIGINT AS level FROM x GROUP BY GROUPING SETS ((version), (score), (version, score), (series_id), ())""")
def summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = src.events(spark, sf)
    facts = None
    for d in (1, 2):
        nc = frames.difference_forecast(e, d).where("t >= 2").select("series_id", (F.col("t") - 2).alias("t"), F.abs(F.col("value") - F.col("pred")).alias("nc"))
        avg = frames.rolling(nc, 49, {"v": lambda w: F.avg("nc").over(w.rowsBetween(-49, 0))}).where("t >= 58")
        one = avg.select("series_id", F.lit(f"d{d}").alias("model"), F.explode(F.array(F.struct(F.lit("avg").alias("score"), F.col("v")), F.struct(F.lit("raw").alias("score"), F.col("nc").alias("v")))).alias("x"))
        one = one.groupBy("series_id", "model", F.col("x.score").alias("score")).agg(F.avg("x.v").alias("v"))
        facts = one if facts is None else facts.unionByName(one)
    sets = [[F.col("model")], [F.col("score")], [F.col("model"), F.col("score")], [F.col("series_id")], []]
    return facts.groupingSets(sets, "model", "score", "series_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.grouping_id().alias("level"))


def _uniform_at(i: int) -> str:
    return fm.hash_uniform_sql(42 + i, "series_id", "(t * 1000)")


@query(f"""{E}, n AS (SELECT series_id, least(max(t) + 1 - 112, 200) - 10 AS first FROM e GROUP BY series_id),
l AS (SELECT e.*, t - first AS i, {_uniform_at(0)} AS u, {_uniform_at(1)} AS v, avg(value) OVER (PARTITION BY series_id) AS mean, stddev_pop(value) OVER (PARTITION BY series_id) AS sd FROM e JOIN n USING (series_id) WHERE t BETWEEN first AND first + 19),
z AS (SELECT *, sqrt(-2.0::DOUBLE * ln(greatest(u, 1e-12))) * cos({2 * math.pi!r}::DOUBLE * v) AS noise FROM l),
o AS (SELECT series_id, t, value + sum(CASE WHEN i < 8 THEN {10 / 8!r}::DOUBLE + mean + noise * ({10 / 16!r}::DOUBLE + sd) ELSE -({10 / 12!r}::DOUBLE + mean + noise * ({10 / 24!r}::DOUBLE + sd)) END) OVER (PARTITION BY series_id ORDER BY t) AS r FROM z)
SELECT e.series_id, e.t, round(coalesce(r, value), 6) AS value FROM e LEFT JOIN o ON o.series_id = e.series_id AND o.t = e.t""")
def anomaly_overlay(spark: SparkSession, sf: str) -> DataFrame:
    e = src.events(spark, sf)
    return training.overlaid(e, training.artificial_anomaly(e, 100)).select("series_id", "t", r6("value"))


# several channels

WINDOW_SQL = f"""{D}, w AS (SELECT *, lag(c0, 9) OVER o AS first0, sum(c0) OVER p AS before0, sum(c1) OVER p AS before1, avg(c0) OVER f AS m0, avg(c1) OVER f AS m1, avg(c2) OVER f AS m2, avg(c3) OVER f AS m3,
  list(c0) OVER f AS l0, list(c1) OVER f AS l1, list(c2) OVER f AS l2, list(c3) OVER f AS l3
  FROM d WINDOW o AS (ORDER BY t), p AS (ORDER BY t ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), f AS (ORDER BY t ROWS 9 PRECEDING))"""


def _channel_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return frames.feature_vectors(src.shipments(spark, sf), 10, value="values")


@query(f"{WINDOW_SQL} SELECT 'lineitem' AS series_id, t, round(before0, 4) AS input0, round(before1, 4) AS input1, c0 AS target0, c3 AS target3, first0, round(list_max(l2), 6) AS top2, 40 AS n FROM w WHERE t >= 9")
def channel_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of ten rows and four channels: what a forecaster reads and predicts, the first row, and the channels."""
    fv = F.col("fv")
    total = lambda c: F.round(F.aggregate(F.transform(frames.input_rows(fv), lambda r: r[c]), F.lit(0.0), lambda s, x: s + x), 4)
    return _channel_vectors(spark, sf).select("series_id", "t", total(0).alias("input0"), total(1).alias("input1"), frames.target_row(fv)[0].alias("target0"), frames.target_row(fv)[3].alias("target3"),
        frames.first_row(fv)[0].alias("first0"), F.round(F.array_max(frames.by_channel(fv)[2]), 6).alias("top2"), F.size(frames.flat(fv)).alias("n"))


@query(f"{WINDOW_SQL}, b AS (SELECT unnest(l2) AS x, unnest(l3) AS y FROM w WHERE t >= 9) SELECT round(x, 6) AS x, count(*) AS n, round(sum(y), 6) AS total FROM b GROUP BY round(x, 6)")
def channel_points(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of all vectors as points, counted and summed by one channel; sums of values of six digits round alike."""
    p = frames.points(_channel_vectors(spark, sf))
    return p.groupBy(F.round(F.col("point")[2], 6).alias("x")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("point")[3]), 6).alias("total"))


def _over(what: str) -> str:
    """A sum over all rows and channels of a vector, of x and its channel's mean m."""
    return " + ".join(f"list_sum(list_transform(l{i}, lambda x: {what.replace('m', f'm{i}')}))" for i in range(4))


@query(f"""{WINDOW_SQL} SELECT 'lineitem' AS series_id, t, round(1 - ({_over("x * m")}) / (sqrt({_over("x * x")}) * sqrt({_over("m * m")})), 6) AS whole,
round(ln(1 + sqrt(pow(c0 - m0, 2) + pow(c1 - m1, 2) + pow(c2 - m2, 2) + pow(c3 - m3, 2))), 6) AS last, round(ln(1 + (abs(c0 - m0) + abs(c1 - m1) + abs(c2 - m2) + abs(c3 - m3)) / 4), 6) AS mean_last FROM w WHERE t >= 9""")
def channel_nonconformity(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors against their channels' means: as a reconstruction by cosine, as a forecast by the last row (logarithms)."""
    fv = F.col("fv")
    mean = F.transform(frames.by_channel(fv), lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c))
    v = _channel_vectors(spark, sf).withColumn("_mean", mean).withColumn("prediction", F.transform("fv", lambda _: F.col("_mean")))
    v = frames.model_nonconformity(v, "reconstruction", "cosine_sim", 4).withColumnRenamed("nc", "whole")
    v = frames.model_nonconformity(v, "forecasting", "euclidean", 4).withColumnRenamed("nc", "last")
    v = frames.model_nonconformity(v, "forecasting", "mean_abs_diff", 4)
    return v.select("series_id", "t", r6("whole"), F.round(F.log1p("last"), 6).alias("last"), F.round(F.log1p("nc"), 6).alias("mean_last"))


@query(f"{NC} SELECT series_id, t, round(nc / max(nc) OVER (PARTITION BY series_id), 6) AS nc FROM n WHERE t < 100")
def nc_warm_up(spark: SparkSession, sf: str) -> DataFrame:
    """A forecaster's scores of the first training set."""
    return frames.over_own_maximum(_nc(spark, sf).where("t < 100")).select("series_id", "t", r6("nc"))


# all approaches at once

_LIKELY = scores.likelihood_sql()
APPROACH_SQL = f"""{E}, {_LIKELY.replace("a AS (SELECT series_id", "al AS (SELECT series_id")},
av AS (SELECT series_id, t, avg(nc) OVER (PARTITION BY series_id ORDER BY t ROWS 49 PRECEDING) AS score FROM n),
a AS (SELECT 'diff-sw_ks-al-anomaly_scores/' || series_id AS series_id, t, round(score, 6) AS score, is_anomaly FROM al
  UNION ALL SELECT 'diff-ures_ks-avg-anomaly_scores/' || e.series_id, e.t, round(score / 100, 6), e.is_anomaly FROM av JOIN e ON e.series_id = av.series_id AND e.t = av.t WHERE e.t >= 49
  UNION ALL SELECT unnest(['diff-sw_ks-al', 'diff-ures_ks-avg']) || '-nonconformity_scores/' || series_id, t, round(nc / 500, 6), is_anomaly FROM n WHERE t >= 49)"""
_APPROACH_CURVES = COUNT_SQL[len(EVAL) :]
_APPROACH_NAB = """la AS (SELECT series_id, max(t) AS last FROM a GROUP BY series_id), i AS (SELECT series_id, k, s, e - s AS len, unnest(range(0, 2 * (e - s))) AS i FROM k WHERE e > s),
m AS (SELECT series_id, least(s + i, last) AS t, arg_max(2.0::DOUBLE / (1.0 + exp(5.0::DOUBLE * (3.0::DOUBLE * i / len - 3))) - 1, k * 1000000 + i) AS r FROM i JOIN la USING (series_id) GROUP BY ALL),
w AS (SELECT a.series_id, a.t, a.score, coalesce(m.r, -1.0::DOUBLE) AS reward, k.k AS seq FROM a LEFT JOIN m ON m.series_id = a.series_id AND m.t = a.t LEFT JOIN k ON k.series_id = a.series_id AND a.t BETWEEN k.s AND k.e),
o AS (SELECT series_id, lv, sum(reward) AS r FROM w JOIN lv ON seq IS NULL AND score > lv.lv * 0.01::DOUBLE GROUP BY ALL),
f AS (SELECT series_id, lv, seq, arg_min(reward, t) AS r FROM w JOIN lv ON seq IS NOT NULL AND reward > 0 AND score > lv.lv * 0.01::DOUBLE GROUP BY ALL),
x AS (SELECT series_id, lv, sum(r) AS r FROM (SELECT * FROM o UNION ALL SELECT series_id, lv, r FROM f) GROUP BY ALL),
nk AS (SELECT series_id, count(*) AS n FROM k GROUP BY series_id),
nn AS (SELECT nk.series_id, lv.lv, round(coalesce(r, 0.0::DOUBLE) / n, 6) AS nab FROM nk CROSS JOIN lv LEFT JOIN x ON x.series_id = nk.series_id AND x.lv = lv.lv)
SELECT series_id, nab, lv AS nab_level FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY nab DESC, lv) AS o FROM nn) WHERE o = 1"""


@query(f"""{APPROACH_SQL}, {ev.SEQUENCES_SQL}, {ev.DETECTIONS_SQL}{_APPROACH_CURVES}{AREA_SQL}, ar AS (SELECT series_id, coalesce(sum(step), 0) / 2 AS area FROM w GROUP BY series_id),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(precision * precision + recall * recall, 9) DESC, lv) AS o FROM q),
vs AS (WITH {ev.SOFT_SQL}, {SOFT_CURVE_SQL}{VOLUME_SQL}), nb AS (WITH {_APPROACH_NAB})
SELECT split_part(ar.series_id, '/', 2) AS dataset, split_part(ar.series_id, '-', 1) AS model, split_part(ar.series_id, '-', 2) AS strategy, split_part(ar.series_id, '-', 3) AS score_kind, split_part(split_part(ar.series_id, '/', 1), '-', 4) AS result,
  round(area, 6) AS area, b.lv AS best, vus, nab, nab_level FROM ar JOIN b ON b.series_id = ar.series_id AND o = 1 JOIN vs ON vs.series_id = ar.series_id JOIN nb ON nb.series_id = ar.series_id""")
def evaluate_approaches(spark: SparkSession, sf: str) -> DataFrame:
    """Two approaches' anomaly scores and the nonconformity that both follow, written by series and approach, read again,
    met with the labels and evaluated together."""
    path = f"{store.shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    nc = _nc(spark, sf)
    both = {("sw_ks", "al"): scores.anomaly_likelihood(nc), ("ures_ks", "avg"): scores.average_of_window(nc).withColumn("score", F.col("score") / 100)}
    kinds = ("anomaly_scores", "nonconformity_scores")
    for (strategy, kind), s in both.items():
        each = {kinds[0]: s, kinds[1]: nc.where("t >= 49").withColumn("score", F.col("nc") / 500)}
        for result, x in each.items():
            store.write_scores(x.select("series_id", "t", F.round("score", 6).alias("score")), f"{path}/{result}", "diff", strategy, kind, "run1", "parquet")
    read = [store.read_scores(spark, f"{path}/{result}", "parquet").withColumn("result", F.lit(result)) for result in kinds]
    rows = ev.aligned(read[0].unionByName(read[1]).withColumnRenamed("series_id", "dataset"), src.events(spark, sf).select(F.col("series_id").alias("dataset"), "t", "is_anomaly"), ev.RESULT_KEYS)
    out = ev.approach_results(rows, store.written, ev.RESULT_KEYS)
    return out.select(*ev.RESULT_KEYS, r6("area"), "best", r6("vus"), "nab", "nab_level")


# weights that are learnt on the way


@query(f"""{E}, x AS (SELECT series_id, t, value, lag(value) OVER o AS x1, value - lag(value) OVER o AS y, lag(value) OVER o - lag(value, 2) OVER o AS a, lag(value, 2) OVER o - lag(value, 3) OVER o AS b FROM e WINDOW o AS (PARTITION BY series_id ORDER BY t)),
s AS (SELECT series_id, t // 64 AS c, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS b_y FROM x WHERE b IS NOT NULL GROUP BY ALL),
w AS (SELECT series_id, c, coalesce(sum(aa) OVER o, 0) + 1 AS aa, coalesce(sum(ab) OVER o, 0) AS ab, coalesce(sum(bb) OVER o, 0) + 1 AS bb, coalesce(sum(ay) OVER o, 0) AS ay, coalesce(sum(b_y) OVER o, 0) AS b_y
  FROM s WINDOW o AS (PARTITION BY series_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT series_id, c, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS g1, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS g2 FROM w)
SELECT x.series_id, x.t, round(x1 + g1 * a + g2 * b, 6) AS pred, round(g1, 6) AS weight1, round(g2, 6) AS weight2 FROM x JOIN g ON g.series_id = x.series_id AND g.c = x.t // 64 WHERE b IS NOT NULL""")
def arima_online(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts by the last value and two past differences, weighed by what all chunks before have taught."""
    f = frames.online_forecast(src.events(spark, sf), 2, 64)
    return f.select("series_id", "t", r6("pred"), F.round(F.col("weights")[0], 6).alias("weight1"), F.round(F.col("weights")[1], 6).alias("weight2"))


VAR_LAGS = 50


@query(f"""WITH RECURSIVE {src.SHIPMENTS_SQL}, {lags.lag_criteria_sql(VAR_LAGS)}
SELECT lag::INTEGER AS lag, round(rss, 5) AS rss, round(aic, 6) AS aic, row_number() OVER (ORDER BY aic, lag) = 1 AS chosen FROM cr""")
def var_lags(spark: SparkSession, sf: str) -> DataFrame:
    """The residuals and criteria of all lags up to 50 of the four shipment channels, from one matrix over the whole
    series."""
    z = lags.standardised(src.shipments(spark, sf), 4)
    return lags.lag_criteria(lags.lag_products(z, VAR_LAGS), VAR_LAGS, 4).select("lag", F.round("rss", 5).alias("rss"), r6("aic"), "chosen")


#: Trees of the forest, points that each takes, and the score over which a point is odd.
TREES, TREE_POINTS, ODD = 100, 128, 0.5
FOREST_SQL = f"""WITH RECURSIVE {src.SHIPMENTS_SQL}, me AS (SELECT {", ".join(f"avg(c{i}) AS m{i}, stddev_pop(c{i}) AS s{i}" for i in range(4))} FROM d),
p AS (SELECT t, {", ".join(f"(c{i} - m{i}) / s{i} AS z{i}" for i in range(4))} FROM d, me), {forest.forest_sql(TREES, TREE_POINTS)}"""


def _forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    points = store.written(lags.standardised(src.shipments(spark, sf), 4).withColumnRenamed("values", "x"))
    nodes = forest.grow(points, forest.first_trees(points, TREES), 4, TREE_POINTS)
    return forest.tree_scores(forest.depths(points, nodes, TREE_POINTS), TREE_POINTS)


@query(f"{FOREST_SQL} SELECT 'lineitem' AS series_id, t, round(avg(score), 6) AS score FROM sc GROUP BY t")
def forest_rows_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How far each day of shipments stands apart, by trees that are rows."""
    return forest.forest_scores(_forest_scores(spark, sf)).select("series_id", "t", r6("score"))


@query(f"""{FOREST_SQL}, al AS (SELECT t, round(avg(score), 9) > {ODD}::DOUBLE AS o FROM sc GROUP BY t)
SELECT 'lineitem' AS series_id, tree::INTEGER AS tree, sum(CASE WHEN (round(score, 9) > {ODD}::DOUBLE) = o THEN 1 ELSE -1 END)::BIGINT AS votes, round(sum(depth), 4) AS depth FROM sc JOIN al USING (t) GROUP BY tree""")
def forest_rows_votes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each tree agrees with the forest, less how often it doesn't, and its depths in all."""
    scored = store.written(_forest_scores(spark, sf))
    deep = scored.groupBy("series_id", "tree").agg(F.round(F.sum("depth"), 4).alias("depth"))
    return forest.tree_votes(scored, ODD).join(deep, ["series_id", "tree"]).select("series_id", "tree", "votes", "depth")


# anomalies put in after each retraining

INJECTED = f"""{E}, {training.mu_sigma_sql(20, 5, 10)}, ev AS (SELECT series_id, t AS rt FROM s WHERE mu_shift > sigma0 OR sigma < sigma0 / 2 OR sigma > sigma0 * 2),
po AS (SELECT ev.series_id, ev.rt, least(n - 112, ev.rt + 100) - 10 AS first FROM ev JOIN (SELECT series_id, max(t) + 1 AS n FROM e GROUP BY series_id) USING (series_id)),
lo AS (SELECT po.series_id, po.rt, po.first, e.t, e.t - po.first AS i, e.value, {fm.hash_uniform_sql(42, "po.series_id", "po.rt", "(e.t * 1000)")} AS u, {fm.hash_uniform_sql(43, "po.series_id", "po.rt", "(e.t * 1000)")} AS v,
  avg(e.value) OVER q AS mean, stddev_pop(e.value) OVER q AS sd FROM po JOIN e ON e.series_id = po.series_id AND e.t BETWEEN po.first AND po.first + 19 WINDOW q AS (PARTITION BY po.series_id, po.rt)),
z AS (SELECT *, sqrt(-2.0::DOUBLE * ln(greatest(u, 1e-12))) * cos({2 * math.pi!r}::DOUBLE * v) AS noise FROM lo),
r AS (SELECT series_id, rt, first, t, value + sum(CASE WHEN i < 8 THEN {10 / 8!r}::DOUBLE + mean + noise * ({10 / 16!r}::DOUBLE + sd) ELSE -({10 / 12!r}::DOUBLE + mean + noise * ({10 / 24!r}::DOUBLE + sd)) END) OVER (PARTITION BY series_id, rt ORDER BY t) AS r FROM z),
o AS (SELECT series_id, t, arg_max(r, rt) AS r FROM r GROUP BY ALL),
b AS (SELECT e.series_id, e.t, e.value, coalesce(o.r, e.value) AS patched FROM e LEFT JOIN o ON o.series_id = e.series_id AND o.t = e.t),
chg AS (SELECT series_id, t, patched, abs(value - lag(value) OVER w) AS before, abs(patched - lag(patched) OVER w) AS after FROM b WINDOW w AS (PARTITION BY series_id ORDER BY t))"""


@query(f"""{INJECTED} SELECT po.series_id, po.rt AS retrained, po.first, po.first + 19 AS last, count(*) AS n, round(max(chg.before), 6) AS top_before, round(max(chg.after), 6) AS top_after, round(sum(chg.patched), 4) AS total
FROM po JOIN chg ON chg.series_id = po.series_id AND chg.t BETWEEN po.first AND po.first + 69 GROUP BY ALL""")
def anomalies_after_retraining(spark: SparkSession, sf: str) -> DataFrame:
    """Each drift of a training set retrains, and puts an artificial anomaly into the rows ahead: where it lies, and the
    largest changes from it to fifty rows behind it, as the series was and as all anomalies have made it."""
    e = store.written(src.events(spark, sf))
    events = store.written(training.mu_sigma_drift(training.mu_sigma(e, 20, 5, 10)).where("drift").select("series_id", F.col("t").alias("at")))
    overlays = store.written(training.anomalies_after(e, events))
    patched = training.overlaid(e.select("series_id", "t", "value", F.col("value").alias("was")), training.last_overlay(overlays))
    change = lambda c: lambda w: F.abs(F.col(c) - F.lag(c, 1).over(w))
    both = frames.rolling(patched, 1, {"before": change("was"), "after": change("value")})
    around = overlays.groupBy("series_id", "at", "first").agg(F.lit(1)).select("series_id", "at", "first", F.explode(F.sequence("first", F.col("first") + 69)).alias("t"))
    out = around.join(both, ["series_id", "t"]).groupBy("series_id", "at", "first").agg(F.count("*").alias("n"), F.max("before").alias("before"), F.max("after").alias("after"), F.sum("value").alias("total"))
    return out.select("series_id", F.col("at").alias("retrained"), "first", (F.col("first") + 19).alias("last"), "n", F.round("before", 6).alias("top_before"), F.round("after", 6).alias("top_after"), F.round("total", 4).alias("total"))


# sequential detection and models


def _online_query(name: str, settings: online.Settings) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return online.detect(src.events(spark, sf), settings, 150)

    run.__name__ = name
    query()(run)


_online_query("online_sliding_ks", online.Settings(training=100, update="sliding", drift="ks"))
_online_query("online_uniform_musigma", online.Settings(training=100, update="uniform", drift="musigma", score="average"))
_online_query("online_aware_al_ks", online.Settings(training=100, update="aware", drift="ks"))
_online_query("confidence_levels_full", online.Settings(training=100, update="sliding", drift="ks", score="confidence", score_rows=10))


#: Rows at the start of a series that its model learns from; of shipments, days.
FIRST, FIRST_DAYS = 150, 1250


def _forest(x: np.ndarray) -> models.Forest:
    """A forest on points, whose trees vote and are renewed once."""
    forest = models.Forest(x[:, None], 200, max(10, min(len(x) // 10, 256)), 7)
    forest.vote(x[:, None], 0.5)
    forest.renew(x[:, None])
    return forest


@query()
def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A forest on the first rows' points, and its scores of the rest."""
    e = src.events(spark, sf)

    def scores_of(t: np.ndarray, x: np.ndarray, forest: models.Forest) -> dict:
        return {"t": t[t >= FIRST], "score": forest.scores(x[t >= FIRST, None])}

    return registry.predicted(e, registry.fit_first(e, FIRST, _forest), 0, scores_of, "series_id string, t long, score double")


@query()
def usad_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine distance of vectors of 20 rows to their reconstruction by two competing decoders, learnt from the first."""
    e = src.events(spark, sf)

    def fit(x: np.ndarray) -> tuple:
        mean, sd, model = x.mean(), x.std() or 1.0, models.Usad(20, 2, 7)
        model.fit(np.lib.stride_tricks.sliding_window_view((x - mean) / sd, 20)[:130], 5)
        return mean, sd, model

    def distances(t: np.ndarray, x: np.ndarray, fitted: tuple) -> dict:
        mean, sd, model = fitted
        if len(x) < 20:
            return {"t": t[:0], "nonconformity": x[:0]}
        w = np.lib.stride_tricks.sliding_window_view((x - mean) / sd, 20)
        return {"t": t[19:], "nonconformity": registry.cosine_distances(w, model.predict(w))}

    return registry.predicted(e, registry.fit_first(e, FIRST, fit, 60), 19, distances, "series_id string, t long, nonconformity double")


@query()
def arima_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Differences plus a weight for each past difference, which least squares finds in the first rows; the forecasts are
    sums over frames."""
    e = src.events(spark, sf)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy(float)
        return pd.DataFrame([(key[0], models.fit_gamma(x, 1, 8))] if len(x) >= 60 else [], columns=["series_id", "gamma"], dtype=object)

    gamma = e.where(F.col("t") < FIRST).select("series_id", "t", "value").groupBy("series_id").applyInPandas(fit, "series_id string, gamma array<double>")
    past = frames.rolling(e, 9, {"past": lambda w: F.collect_list("value").over(w.rowsBetween(-9, -1))}).where("t >= 9")
    change = sum((F.col("gamma")[i] * (F.col("past")[8 - i] - F.col("past")[7 - i]) for i in range(1, 8)), F.col("gamma")[0] * (F.col("past")[8] - F.col("past")[7]))
    return past.join(gamma, "series_id").select("series_id", "t", (F.col("past")[8] + change).alias("pred"))


@query()
def var_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """One-step forecasts of the four shipment channels, by lags that the first days choose and weigh."""
    s = src.shipments(spark, sf)

    def fit(x: np.ndarray) -> tuple:
        mean, sd = x.mean(0), np.maximum(x.std(0), 1e-12)
        return mean, sd, models.Var((x - mean) / sd)

    def errors(t: np.ndarray, x: np.ndarray, fitted: tuple) -> dict:
        mean, sd, model = fitted
        x = (x - mean) / sd
        if len(x) <= model.lag:
            return {"t": t[:0], "lag": t[:0], "error": x[:0, 0]}
        return {"t": t[model.lag :], "lag": model.lag, "error": np.abs(x[model.lag :] - model.predict(x)).mean(1)}

    model = registry.fit_first(s, FIRST_DAYS, fit, 60, "values")
    return registry.predicted(s, model, 50, errors, "series_id string, t long, lag int, error double", "values").drop("series_id")


@query()
def model_registry_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of an autoencoder, each in force from its row on."""
    e = src.events(spark, sf)
    return registry.score_with(e, registry.fit_models(e, "autoencoder", [100, 150]))


# networks as rows

_LENGTH, _TAUGHT, _EPOCHS, _BATCHES, _RATE = 20, 100, 5, 1, 0.01


def _net_sql(net: nets.Net) -> str:
    return f"""{E}, wd AS MATERIALIZED (SELECT series_id, t, x FROM (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS {_LENGTH - 1} PRECEDING) AS x FROM e) WHERE t >= {_LENGTH - 1}),
ver AS MATERIALIZED (SELECT series_id, version, floor(n * share)::BIGINT AS from_t, version = 2 AS fork FROM (SELECT series_id, count(*) AS n FROM e GROUP BY series_id), (VALUES (0, 0.5::DOUBLE), (1, 0.75::DOUBLE), (2, 0.875::DOUBLE)) v(version, share)),
mb AS MATERIALIZED (SELECT v.series_id, v.version, w.t, w.x FROM ver v JOIN wd w ON w.series_id = v.series_id AND w.t >= v.from_t - {_TAUGHT} AND w.t < v.from_t),
{nets.fit_sql(net, 3, _EPOCHS, _BATCHES, _RATE)}, {nets.score_sql(net)} SELECT series_id, t, version, round(nc, 6) AS nc FROM nn"""


def _net_scores(spark: SparkSession, sf: str, net: nets.Net) -> DataFrame:
    e = src.events(spark, sf)
    vectors = store.written(frames.feature_vectors(e, _LENGTH).select("series_id", "t", "fv"))
    n = e.groupBy("series_id").agg(F.count("*").alias("_n"))
    share = F.explode(F.array(*[F.struct(F.lit(i).alias("version"), F.lit(s).alias("share")) for i, s in enumerate((0.5, 0.75, 0.875))])).alias("_v")
    versions = n.select("series_id", "_n", share).select("series_id", "_v.version", F.floor(F.col("_n") * F.col("_v.share")).alias("from_t"), (F.col("_v.version") == 2).alias("fork"))
    versions = store.written(versions)
    fitted = nets.fit(vectors, versions, nets.sliding_members(versions, _TAUGHT), net, _EPOCHS, _BATCHES, _RATE)
    return nets.score(vectors, versions, fitted, net).select("series_id", "t", "version", r6("nc"))


AUTOENCODER, USAD = nets.autoencoder(_LENGTH), nets.usad(_LENGTH, _LENGTH // 10)


@query(_net_sql(AUTOENCODER))
def autoencoder_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 20 rows against an autoencoder that learns from the last 100 before the half of each series, goes on
    learning at three quarters, and is replaced at seven eighths by a fork with fresh weights."""
    return _net_scores(spark, sf, AUTOENCODER)


@query(_net_sql(USAD))
def usad_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The same with two decoders on one encoder; the output that fits best is the one scored against."""
    return _net_scores(spark, sf, USAD)


# streaming


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.finished(jobs.tumbling_counts(jobs.event_stream(spark, sf)), store.shared_folder(spark), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"{NC}, s AS (SELECT series_id, t, avg(nc) OVER (PARTITION BY series_id ORDER BY t ROWS 49 PRECEDING) AS score FROM n) SELECT series_id, t, round(score, 6) AS score FROM s WHERE t >= 49")
def stream_stateful_score(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.rolling_scores(jobs.event_stream(spark, sf), store.shared_folder(spark)).select("series_id", "t", r6("score"))


#: Triggers of the replayed streams: days of events each, and how much later than its own a row may come.
REPLAY_DAYS, REPLAY_LATE = 5, 20
LOOP = loop.Settings(training=100, shift=0.1, pull=1 / 3)


def _of_days(days: int) -> F.Column:
    return F.floor(F.unix_date(F.to_date("ts")) / days)


@query(f"""WITH RECURSIVE {src.EVENTS_SQL.replace("FROM events", ", ts FROM events")}, {loop.version_tree_sql(f"floor(date_diff('day', DATE '1970-01-01', ts::DATE) / {REPLAY_DAYS}.0)", LOOP)}""")
def version_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Events replayed in triggers of five days: every model version that drift has made, what it descends from, and what
    it has scored."""
    run = loop.VersionLoop(spark, store.shared_folder(spark), LOOP)
    loop.replay(src.table(spark, sf, "events"), _of_days(REPLAY_DAYS), f"{run.at}/in", run.run)
    out = loop.tree_report(run)
    return out.select("series_id", "strategy", "version", F.coalesce("parent", F.lit(-1)).alias("parent"), "from_t", "depth", "lineage", r6("mu"), "n", F.round("total_nc", 4).alias("total_nc"))


@query(f"{NC}, s AS (SELECT series_id, t, avg(nc) OVER (PARTITION BY series_id ORDER BY t ROWS 49 PRECEDING) AS score FROM n) SELECT series_id, t, round(score, 6) AS score FROM s WHERE t >= 49")
def stream_late_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events of which a third come a trigger late, put in order by state and watermark, then scored as they leave it."""
    folder = f"{store.shared_folder(spark)}/late-{uuid.uuid4().hex}"
    e = src.table(spark, sf, "events")
    last = loop.end_of_stream(e, REPLAY_LATE)
    spark.createDataFrame([], jobs.SCHEMA).write.parquet(folder)
    stream = spark.readStream.schema(jobs.SCHEMA).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))

    def run(start: Callable[[], None]) -> None:
        def each(_: str, done: bool) -> None:
            if done:
                last.write.mode("append").parquet(folder)
            start()

        loop.replay(e, _of_days(REPLAY_LATE // 2) + F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, 1).otherwise(0), folder, each)

    with loop.rocks(spark):
        return jobs.rolling_scores(loop.in_order(stream, f"{REPLAY_LATE} days"), store.shared_folder(spark), run=run).select("series_id", "t", r6("score"))
