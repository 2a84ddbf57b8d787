import math
import os
import pickle

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import math as fm
from driftline.operators import evaluate as ev
from driftline.operators import frames, models, online, registry, scores, training
from driftline.sources import series as src
from driftline.sources import store
from driftline.streaming import jobs


def series(spark, values, labels=None, name="s"):
    labels = labels or [0] * len(values)
    return spark.createDataFrame([(name, i, float(v), int(a)) for i, (v, a) in enumerate(zip(values, labels, strict=True))], "series_id string, t long, value double, is_anomaly int")


def test_normal_cdf(spark):
    z = np.linspace(-4, 4, 81)
    df = spark.createDataFrame([(float(x),) for x in z], "z double")
    got = np.asarray([r[0] for r in df.select(fm.normal_cdf(F.col("z"))).collect()])
    assert np.abs(got - [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z]).max() < 1e-12


def test_measures(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(fm.euclidean(F.col("a"), F.col("b")), fm.mean_abs_diff(F.col("a"), F.col("b")), fm.cosine_distance(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(math.sqrt(5)) and rows[0][1] == 1.5 and rows[0][2] == pytest.approx(0)
    assert rows[1][2] is None
    got = df.select(fm.pearson_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(0) and got[1][0] is None


def test_difference_factors_continue_polynomials():
    for d in (1, 2, 3, 4):
        x = [t ** (d - 1) for t in range(10)]
        assert sum(c * x[8 - k] for k, c in enumerate(fm.difference_factors(d))) == x[9]


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_frames_do_not_depend_on_chunks(spark, chunk):
    s = series(spark, range(20))
    got = frames.rolling(s, 4, {"m": lambda w: F.sum("value").over(w.rowsBetween(-4, 0)), "next": lambda w: F.lead("value").over(w)}, after=1, chunk=chunk).orderBy("t").collect()
    assert [r["m"] for r in got] == [sum(range(max(0, t - 4), t + 1)) for t in range(20)]
    assert [r["next"] for r in got] == [*map(float, range(1, 20)), None]


def test_numbered(spark):
    df = spark.createDataFrame([("a", 5, 0), ("a", 3, 0), ("a", 11, 1), ("b", 1, 0)], "series_id string, ts int, hour int")
    got = {(r["series_id"], r["ts"]): r["t"] for r in src.numbered(df, "series_id", ["ts"], F.col("hour")).collect()}
    assert got == {("a", 3): 0, ("a", 5): 1, ("a", 11): 2, ("b", 1): 0}


def test_likelihood_rises_after_a_step(spark):
    nc = series(spark, [0.1] * 60 + [5.0] * 60).withColumnRenamed("value", "nc")
    got = {r["t"]: r["score"] for r in scores.anomaly_likelihood(nc).collect()}
    assert got[59] == pytest.approx(0.5) and got[65] > 0.7


def brute_runs(y):
    out, start = [], None
    for i, v in enumerate([*y, 0]):
        if v and start is None:
            start = i
        elif not v and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def test_sequences(spark):
    y = [int(c) for c in "0110001000111"]
    got = [(r["s"], r["e"]) for r in ev.sequences(series(spark, y, y)).orderBy("k").collect()]
    assert got == [(1, 2), (6, 6), (10, 12)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 99), st.booleans()), min_size=5, max_size=40))
def test_counts_like_the_greedy_procedure(spark, rows):
    score, y = [r[0] / 100 + 0.005 for r in rows], [int(r[1]) for r in rows]
    if not any(y):
        return
    s = series(spark, score, y).withColumn("score", F.col("value"))
    got = {r["lv"]: (r["tp"], r["fp"], r["fn"]) for r in ev.counts(ev.detections(s), ev.sequences(s), width=4).collect()}
    true = brute_runs(y)
    for lv in (0, 20, 50, 90):
        found, tp = brute_runs([v > lv * 0.01 for v in score]), 0
        for a, b in true:
            hit = [p for p in found if p[0] <= b and p[1] >= a]
            tp += bool(hit)
            found = [p for p in found if p not in hit]
        assert got[lv] == (tp, len(found), len(true) - tp)


def brute_soft(y, b):
    out, n = [float(v) for v in y], len(y)
    h = b // 2
    for s, e in brute_runs(y):
        for t in range(max(0, s - h), s):
            out[t] = math.sqrt(1 - (s - t) / b)
        for t in range(e, min(n - 1, e + h)):
            out[t] = math.sqrt(1 - (t - e) / b)
    return out


def test_soft_labels(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(120) > 0.9).astype(int).tolist()
    s = series(spark, rng.random(120), y).withColumn("score", F.col("value"))
    rows = ev.soft_labels(s, ev.sequences(s)).collect()
    for b in (0, 20, 60):
        got = [r["soft"] for r in sorted((r for r in rows if r["buffer"] == b), key=lambda r: r["t"])]
        assert np.allclose(got, brute_soft(y, b) if b else y)


def test_soft_labels_like_marks_set_one_after_the_other(spark):
    rng = np.random.default_rng(8)
    y = np.zeros(900, int)
    for at in (3, 40, 60, 61, 200, 290, 300, 500, 890):
        y[at : at + int(rng.integers(1, 25))] = 1
    s = series(spark, y.tolist(), y.tolist()).withColumn("score", F.col("value"))
    runs = sorted((r["k"], r["s"], r["e"]) for r in ev.sequences(s).collect())
    got = {(r["buffer"], r["t"]): r["soft"] for r in ev.soft_labels(s, ev.sequences(s)).collect()}
    for b in ev.BUFFERS:
        soft = y.astype(float)
        for _, start, end in runs if b else []:
            for t in range(max(0, start - b // 2), start):
                soft[t] = math.sqrt(1 - (start - t) / b)
            for t in range(end, min(len(y) - 1, end + b // 2)):
                soft[t] = math.sqrt(1 - (t - end) / b)
        assert np.allclose([got[b, t] for t in range(len(y))], soft), b


def test_levels_below(spark):
    x = [None, math.nan, math.inf, -math.inf, -0.5, 0.0, 1.0, 1.5, *[k * 0.01 for k in range(101)], *[math.nextafter(k * 0.01, 9) for k in range(101)], *np.random.default_rng(1).random(500).tolist()]
    got = spark.createDataFrame([(v,) for v in x], "score double").select("score", ev.levels_below("score").alias("m")).collect()
    for r in got:
        v = r["score"]
        assert r["m"] == (0 if v is None else 100 if math.isnan(v) else sum(v > k * 0.01 for k in range(100))), v


def test_nab_like_the_procedure(spark):
    rng = np.random.default_rng(1)
    y = [int(c) for c in "0001111100000000111000000001000000111111"]
    score = rng.random(len(y)).round(3)
    s = series(spark, score, y).withColumn("score", F.col("value"))
    true = ev.sequences(s)
    got = {r["lv"]: r["nab"] for r in ev.nab_scores(ev.nab_rewards(s, true), true).collect()}
    r, n = [-1.0] * len(y), len(y)
    sig = lambda v: 2 / (1 + math.exp(5 * v)) - 1
    for a, b in brute_runs(y):
        for i in range(2 * (b - a)):
            r[min(a + i, n - 1)] = sig(3 * i / (b - a) - 3)
    for lv in (0, 30, 60, 95):
        c = [x * (v > lv * 0.01) for x, v in zip(r, score, strict=True)]
        for a, b in brute_runs(y):
            first = next((t for t in range(a, b + 1) if c[t] > 0), None)
            for t in range(a, b + 1):
                c[t] = c[t] if t == first else 0
        assert got[lv] == pytest.approx(sum(c) / len(brute_runs(y)), abs=1e-6)


def test_reservoirs(spark):
    s = series(spark, range(500)).withColumn("score", F.lit(0.5))
    got = [r["t"] for r in training.uniform_reservoir(s, 100).collect()]
    assert len(set(got)) == 100 and 150 < np.mean(got) < 350
    assert training.priority_reservoir(s, 1000).count() == 500
    some = s.withColumn("score", F.when(F.col("t") % 10 == 0, F.lit(float("nan"))).when(F.col("t") % 10 == 5, F.col("score")))
    assert {r["t"] % 10 for r in training.priority_reservoir(some, 100).collect()} == {5}


def test_ks_two_sample(spark):
    a, b = [1, 2, 2, 3], [2, 3, 4, 4, 5]
    df = spark.createDataFrame([("k", 0, float(x)) for x in a] + [("k", 1, float(x)) for x in b], "key string, side int, x double")
    r = training.ks_two_sample(df, ["key"]).first()
    assert (r["n1"], r["n2"]) == (4, 5) and r["d"] == pytest.approx(online.ks_statistic(np.asarray(a), np.asarray(b)))


def test_multiplicities(spark):
    w = np.lib.stride_tricks.sliding_window_view(np.arange(19), 10).ravel()
    got = [r[0] for r in spark.range(19).select(training.vector_multiplicity(F.col("id"), 10, 10)).collect()]
    assert got == np.bincount(w).tolist()


def test_versions(spark):
    s = series(spark, range(6))
    v = spark.createDataFrame([("s", 2, 1), ("s", 5, 2)], "series_id string, from_t long, version int")
    assert [r["version"] for r in training.versions_asof(s, v).orderBy("t").collect()] == [None, None, 1, 1, 1, 2]


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_chunks_know_what_is_ahead(spark, chunk):
    rng = np.random.default_rng(chunk)
    y = (rng.random(120) < 0.5).astype(int).tolist()
    y[30:60] = [1] * 30
    s = series(spark, y, y)
    at = sorted(rng.choice(120, 9, replace=False).tolist())
    v = spark.createDataFrame([("s", t, i) for i, t in enumerate(at)], "series_id string, from_t long, version int")
    got = [r["version"] for r in training.versions_asof(s, v, chunk).orderBy("t").collect()]
    assert got == [max((i for i, f in enumerate(at) if f <= t), default=None) for t in range(120)]
    starts = [t for t in range(120) if y[t] and not (t and y[t - 1])]
    want = [(k, t, next(e for e in range(t, 120) if e == 119 or not y[e + 1])) for k, t in enumerate(starts)]
    assert [(r["k"], r["s"], r["e"]) for r in ev.sequences(s, chunk=chunk).orderBy("k").collect()] == want


@pytest.mark.parametrize("at,first", [(100, 190), (350, 278)])
def test_overlay(spark, at, first):
    """Against a plain loop over rows and channels, on the same noise."""
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, (400, 2))
    df = spark.createDataFrame([("s", i, [float(v) for v in r]) for i, r in enumerate(x)], "series_id string, t long, values array<double>")
    noise = {}
    for ch in range(2):
        u = [F.col("t") * 1000 + ch]
        for r in df.select("t", *[training.hash_uniform(42 + i, F.col("series_id"), *u).alias(f"u{i}") for i in (0, 1)]).collect():
            noise[r["t"], ch] = math.sqrt(-2 * math.log(r["u0"])) * math.cos(2 * math.pi * r["u1"])
    want = x.copy()
    part = x[first : first + 20]
    mean, std = part.mean(0), part.std(0)
    for ch in range(2):
        error = 0.0
        for i in range(20):
            steps = 8 if i < 8 else 12
            change = 10 / steps + mean[ch] + noise[first + i, ch] * (10 / (2 * steps) + std[ch])
            error += change if i < 8 else -change
            want[first + i, ch] += error
    out = training.overlaid(df, training.artificial_anomaly(df, at, channels=2), "values").orderBy("t").collect()
    assert np.allclose([r["values"] for r in out], want)
    one = df.select("series_id", "t", F.col("values")[0].alias("value"))
    got = [r["value"] for r in training.overlaid(one, training.artificial_anomaly(one, at)).orderBy("t").collect()]
    assert np.allclose(got, want[:, 0])


def test_aligned(spark):
    labels = spark.createDataFrame([("a", t, int(t == 3)) for t in range(8)] + [("b", t, 1) for t in range(8)], "dataset string, t long, is_anomaly int")
    rows = [(d, "m", "s", k, t, float("nan") if t == 4 else t / 10) for d in "ab" for k in ("al", "cl", "avg") for t in range(2, 10)]
    scored = spark.createDataFrame(rows, "dataset string, model string, strategy string, score_kind string, t long, score double")
    got = ev.aligned(scored, labels).collect()
    assert {(r["series_id"]["dataset"], r["series_id"]["score_kind"]) for r in got} == {("a", "al"), ("a", "avg")}
    assert sorted(r["t"] for r in got if r["series_id"]["score_kind"] == "al") == [2, 3, 5, 6, 7]
    out = {r["score_kind"]: r for r in ev.approach_results(ev.aligned(scored, labels), store.written).collect()}
    rows = ev.aligned(scored, labels).where("series_id.score_kind = 'al'").select(F.lit("x").alias("series_id"), "t", "score", "is_anomaly")
    true = ev.sequences(rows)
    alone = ev.area(ev.precision_recall(ev.counts(ev.detections(rows), true)), ["series_id"]).first()
    assert (out["al"]["area"], out["al"]["best"]) == (alone["area"], alone["best"]) and out["al"]["vus"] == out["avg"]["vus"]
    best = max(r["nab"] for r in ev.nab_scores(ev.nab_rewards(rows, true), true).collect())
    assert out["al"]["nab"] == best


def test_fan_out(spark):
    names = store.approaches(spark).withColumn("model", F.lit("m"))
    nc = spark.createDataFrame([("m", i, 0.1 * i) for i in range(3)], "model string, t long, nc double")
    assert store.fan_out(nc, names).count() == 3 * names.count()
    one = spark.createDataFrame([("usad-ares_al_ks-al",)], "name string").select(*store.approach_parts(F.col("name"))).first()
    assert tuple(one) == ("usad", "ares_al_ks", "al")


def test_priority_admission():
    assert online.kept_by_priority(np.asarray([0.1, 0.5, 0.3]), np.asarray([0.2, 0.25, 0.4])) == ([0, 2], [0, 2])


def test_uniform_p_values():
    d, p = online.uniform_p_value(np.linspace(0.005, 0.995, 100))
    assert d == pytest.approx(0.005) and p > 0.999
    assert online.uniform_p_value(np.linspace(0, 0.5, 100))[1] < 1e-6
    # n = 10, d = 0.274 has a p-value near 0.37
    assert online.uniform_p_value(np.asarray([0.126, 0.2, 0.26, 0.3, 0.35, 0.4, 0.5, 0.6, 0.626, 0.7]))[1] == pytest.approx(0.30, abs=0.12)


@pytest.mark.parametrize("update", ["sliding", "uniform", "aware"])
@pytest.mark.parametrize("drift", ["ks", "musigma"])
def test_online(update, drift):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 1, 400)])
    a = online.Approach(online.Settings(training=100, update=update, drift=drift, check_every=1))
    a.start(x[:200])
    rows = [r for at in range(200, 800, 50) for r in a.step(x[at : at + 50])]
    assert [r[0] for r in rows] == list(range(200, 800)) and len(a.train) == 100
    assert all(0 <= r[2] <= 1 for r in rows)
    if update == "sliding":
        assert a.version >= 1


def test_models():
    rng = np.random.default_rng(0)
    x = np.zeros((300, 2))
    for t in range(1, 300):
        x[t] = x[t - 1] @ [[0.5, 0.2], [0.0, 0.7]] + rng.normal(0, 0.1, 2)
    v = models.Var(x)
    assert np.abs(v.coef[1:3] - [[0.5, 0.2], [0.0, 0.7]]).max() < 0.2
    f = models.Forest(rng.normal(0, 1, (300, 2)), 50, 64, 0)
    s = f.scores(np.asarray([[0.0, 0.0], [9.0, 9.0]]))
    assert s[1] > s[0]
    f.vote(x, 0.5)
    f.renew(x)
    assert not f.counters.any()
    w = np.sin(np.arange(400) / 5)[np.arange(20) + np.arange(380)[:, None]]
    for m in (models.Usad(20, 4, 0), models.Autoencoder(20, 0)):
        m.fit(w, 150)
        assert ((m.predict(w) - w) ** 2).mean() < 0.3


def test_files(spark, tmp_path):
    pd.DataFrame({"ts": [1, 2, 3], "a": [1.0, 2.0, 3.0], "b": [0, 0, 1], "is_anomaly": [0, 1, 0]}).to_csv(tmp_path / "x.test.csv", index=False)
    got = src.read_series(spark, str(tmp_path / "x.test.csv"), "ts", "is_anomaly").orderBy("t").collect()
    assert [r["values"] for r in got] == [[1.0, 0.0], [2.0, 0.0], [3.0, 1.0]] and [r["is_anomaly"] for r in got] == [0, 1, 0]
    df = spark.createDataFrame([("s", 1, 0.5)], "series_id string, t long, anomaly_score double")
    for run in ("2024", "2025"):
        store.write_scores(df, str(tmp_path / "out"), "usad", "sw_ks", "al", run)
    assert store.read_scores(spark, str(tmp_path / "out")).count() == 1
    store.write_overlay(spark.createDataFrame([(1, 2.0)], "t long, ch0 double"), str(tmp_path / "art"), 90, 110)
    got = store.read_overlays(spark, str(tmp_path / "art"), "t long, ch0 double").first()
    assert (got["t"], got["ch0"], got["first"], got["last"]) == (1, 2.0, 90, 110)
    (tmp_path / "usad-ks-step500.bin").write_bytes(b"w")
    assert [(r["step"], bytes(r["content"])) for r in store.model_files(spark, str(tmp_path / "*.bin")).collect()] == [(500, b"w")]
    store.write_results(df, str(tmp_path / "json"))
    assert store.read_results(spark, str(tmp_path / "json"), "series_id string, t long, anomaly_score double").collect() == df.collect()


def test_var_finds_a_weekly_lag():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 2))
    for i in range(7, 600):
        x[i] += 0.8 * x[i - 7]
    v = models.Var(x)
    assert 7 <= v.lag <= 9
    assert np.abs(v.coef[13:15] - 0.8 * np.eye(2)).max() < 0.1


def test_iforest_query_builds_200_trees():
    from driftline.plans import catalogue

    assert len(catalogue._forest(np.sin(np.arange(150.0))).trees) == 200


def _three_series(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, float(v)) for k, n in (("a", 700), ("b", 130), (None, 400)) for t, v in enumerate(rng.normal(0, 1, n))]
    return spark.createDataFrame(rows, "series_id string, t long, value double")


def test_detect_like_one_series_after_the_other(spark):
    s = online.Settings(training=100, update="aware", check_every=1)
    want = []
    series = _three_series(spark)
    for key, pdf in series.toPandas().groupby("series_id", dropna=False):
        x = pdf.sort_values("t")["value"].to_numpy()
        if len(x) > 150:
            a = online.Approach(s)
            a.start(x[:150])
            want += [(str(key), *r) for at in range(150, len(x), s.step) for r in a.step(x[at : at + s.step])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # batches end within ticks
    try:
        got = [(str(r["series_id"] if r["series_id"] is not None else np.nan), *r[1:]) for r in online.detect(series, s, 150).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and len(got) == 550 + 250
    assert online.detect(series.where("false"), s, 150).count() == 0


@pytest.mark.parametrize("chunk", [32, 100, 10_000])
def test_models_score_chunks_like_whole_series(spark, chunk):
    series = _three_series(spark)
    fitted = registry.fit_models(series, "autoencoder", [100, 150])
    want = []
    for r in fitted.orderBy("from_t").collect():
        x = series.where(F.col("series_id").eqNullSafe(F.lit(r["series_id"]))).orderBy("t").toPandas()["value"].to_numpy()
        mean, sd, model = pickle.loads(r["weights"])
        w = (np.lib.stride_tricks.sliding_window_view(x, 20) - mean) / sd
        p = model.predict(w)
        nc = 1 - (w * p).sum(1) / np.linalg.norm(w, axis=1) / np.linalg.norm(p, axis=1)
        want += [(str(r["series_id"]), t + 19, r["version"], round(float(v), 9)) for t, v in enumerate(nc) if (100 <= t + 19 < 150 if r["version"] == 0 else t + 19 >= 150)]
    got = [(str(r["series_id"]), r["t"], r["version"], round(r["nc"], 9)) for r in registry.score_with(series, fitted, chunk=chunk).collect()]
    assert sorted(got) == sorted(want)


def test_models_of_first_rows_meet_chunks(spark):
    series = _three_series(spark)
    fitted = registry.fit_first(series, 50, lambda x: x.sum(), 50)
    got = registry.predicted(series, fitted, 3, lambda t, x, m: {"t": t, "s": np.convolve(x, np.ones(4))[: len(x)] + m}, "series_id string, t long, s double", chunk=64).toPandas()
    for key, pdf in series.toPandas().groupby("series_id", dropna=False):
        x = pdf.sort_values("t")["value"].to_numpy()
        mine = got[got["series_id"].isna()] if pd.isna(key) else got[got["series_id"] == key]
        assert np.allclose(mine.sort_values("t")["s"], np.convolve(x, np.ones(4))[: len(x)] + x[:50].sum())
    assert registry.fit_first(series, 50, len, 51).count() == 0


def test_stream_scores_go_on_from_trigger_to_trigger(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=37 * i), 1, "ab"[int(rng.integers(2))] if i % 90 else "rare", float(rng.normal()), "") for i in range(600)]
    for k, (at, to) in enumerate([(0, 30), (30, 200), (200, 205), (205, 600)]):
        path = tmp_path / "in" / f"events{k}.parquet"
        path.parent.mkdir(exist_ok=True)
        pd.DataFrame(rows[at:to], columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).sample(frac=1, random_state=k).to_parquet(path, index=False)
        os.utime(path, (1e9 + k, 1e9 + k))  # files come in the order of their times
    stream = spark.readStream.schema(jobs.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["series_id"], r["t"]): r["score"] for r in jobs.rolling_scores(stream, str(tmp_path / "out"), 20).collect()}
    want = {}
    for kind in ("a", "b", "rare"):
        x = np.asarray([r[4] for r in rows if r[3] == kind])
        nc = np.abs(np.diff(x, prepend=x[:1]))
        want |= {(kind, t): nc[t - 19 : t + 1].mean() for t in range(19, len(x))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
