"""Operators that take a long series in parts, against plain sequential versions; streams that loop or come late."""

import datetime
import fractions
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import math as fm
from driftline.operators import evaluate, forest, frames, held, lags, online, scores, training
from driftline.sources import store
from driftline.streaming import jobs, loop


def test_p_values_are_those_of_the_matrix(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice([0.3, 0.6, 1.0, 1.6, 2.4]) / math.sqrt(n)) for n in (1, 5, 31, 32, 50, 77, 120, 200, 250, 400)] + [(40, 0.0), (40, 1.0), (40, 0.0124), (40, None), (None, 0.2), (250, 0.5)]
    got = spark.createDataFrame(rows, "n long, d double").withColumn("p", fm.uniform_p_value(F.col("n"), F.col("d"))).collect()

    def plain(n, d):
        # values whose statistic is d: the i-th at i / n - d, but not below 0
        c = [max(0.0, (i + 1) / n - d) for i in range(n)]
        found, p = online.uniform_p_value(np.asarray(c))
        assert found == pytest.approx(d, abs=1e-12)
        return p

    for r in got:
        if r["n"] is None or r["d"] is None:
            assert r["p"] is None
        elif r["d"] == 1:
            assert r["p"] == 0
        elif 2 * r["n"] * r["d"] <= 1:
            assert r["p"] == 1
        else:
            assert r["p"] == pytest.approx(plain(r["n"], r["d"]), abs=1e-10), r
    tiny = next(r["p"] for r in got if (r["n"], r["d"]) == (250, 0.5))
    # twice the one-sided sum, in whole numbers
    exact = float(2 * sum(fractions.Fraction(math.comb(250, j) * 125 * (125 - j) ** (250 - j)) * fractions.Fraction(125 + j) ** (j - 1) for j in range(126)) / fractions.Fraction(250) ** 250)
    assert tiny == pytest.approx(exact, rel=1e-9) and 0 < tiny < 1e-40


def test_one_matrix_for_equal_distances():
    """The matrix is worked out once for a number of values and a distance."""
    online._uniform_tail.cache_clear()
    c = np.arange(40) / 100 + 0.3
    assert online.uniform_p_value(c) == online.uniform_p_value(c[::-1])
    assert online._uniform_tail.cache_info()[:2] == (1, 1)


def test_scale_functions_follow_one_another():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.choice([rng.exponential(2, 60), rng.uniform(0, 92, 60), np.repeat(rng.uniform(0, 60, 12), 5)])
        start, cut = rng.choice([1.0, 3.0, 30.0, 97.0]), int(rng.integers(0, 61))
        whole = scores.scale_steps(x, start)
        scale = start
        for part in (x[:cut], x[cut:]):
            tops, ends = scores.scale_function(part)
            scale = next((e for t, e in zip(tops, ends, strict=True) if t > scores.NEAR * scale), scale)
        assert scale == whole[-1]


def test_unified_in_chunks(spark):
    rng = random.Random(4)
    p = [None if rng.random() < 0.1 else min(1.0, 10 ** -rng.choice([0, 0.1, 0.5, 1, 4, 12, 30, 45]) * rng.random()) for _ in range(400)]
    want, window, scale = {}, [], 1.0
    for t, x in enumerate(p):
        if x is None:
            continue
        window = [*window, -math.log(min(1.0, max(1e-40, x)))][-25:]
        want[t] = (window[-1] - min(window)) / min(1e6, max(1e-6, max(scale, *window) - min(window)))
        if max(window) > 0.9 * scale:
            scale = max(window) + 5
    df = spark.createDataFrame([(s, t, x) for s in "ab" for t, x in enumerate(p)], "series_id string, t long, p_value double")
    for chunk in (7, 8192):
        got = {(r["series_id"], r["t"]): r["score"] for r in scores.unified(df, chunk=chunk).collect()}
        assert got == pytest.approx({(s, t): x for s in "ab" for t, x in want.items()})
    assert scores.unified(df.limit(0)).count() == 0


def test_reservoir_as_one_row_after_the_other(spark):
    n, step, length = 30, 8, 400
    df = spark.createDataFrame([(s, t) for s in ("x", "y") for t in range(length)] + [("short", t) for t in range(7)], "series_id string, t long")
    u = lambda seed, s, k: int(__import__("hashlib").md5(f"{seed}|{s}|{k}".encode()).hexdigest()[:8], 16) / 2**32
    want = set()
    for s in ("x", "y"):
        slots = list(range(n))
        for t in range(n - 1, length):
            k, left = divmod(t + 1 - n, step)
            if k and not left and u(42, s, k - 1) < n / t:
                strides = training.coprimes(n)
                at, stride = int(u(43, s, k - 1) * n), strides[int(u(44, s, k - 1) * len(strides))]
                taken = [(at + i * stride) % n for i in range(step)]
                assert len(set(taken)) == step
                for i, slot in enumerate(taken):
                    slots[slot] = n + (k - 1) * step + i
            if t % 10 == 0:
                want |= {(s, t, slot, x) for slot, x in enumerate(slots)}
    writes = training.reservoir_writes(df, n, step)
    got = training.reservoir_at(writes, 10, df.groupBy("series_id").agg((F.max("t") + 1).alias("n")))
    assert {tuple(r) for r in got.select("series_id", "at", "slot", "t").collect()} == want
    with pytest.raises(ValueError):
        training.reservoir_writes(df, 5, 6)


def test_ks_by_ranges(spark):
    rng = np.random.default_rng(5)
    hot = [("hot", int(i % 3 == 0), float(x)) for i, x in enumerate(np.round(rng.normal(0, 1, 3000) + np.arange(3000) % 3 * 0.1, 2))]
    rows = hot + [("two", 0, 1.0), ("two", 1, 1.0), ("two", 1, 2.0), ("odd", 0, None), ("odd", 0, 1.0), ("odd", 1, 3.0)]
    got = {r["k"]: (r["n1"], r["n2"], r["d"]) for r in training.ks_two_sample(spark.createDataFrame(rows, "k string, side int, x double"), ["k"]).collect()}
    a, b = (np.asarray([x for _, s, x in hot if s == side]) for side in (0, 1))
    assert got["hot"] == (len(a), len(b), pytest.approx(online.ks_statistic(a, b)))
    assert got["two"] == (1, 2, pytest.approx(0.5)) and got["odd"] == (1, 1, 1.0)


def test_detections_in_chunks(spark):
    rng = random.Random(6)
    x = [rng.choice([0.1, 0.5, 0.55, 0.9]) if rng.random() < 0.7 else 0.95 for _ in range(200)] + [0.99] * 40
    df = spark.createDataFrame([(s, t, v) for s in "ab" for t, v in enumerate(x)], "series_id string, t long, score double")
    whole = {tuple(r) for r in evaluate.detections(df, [20, 52, 93]).collect()}
    assert {tuple(r) for r in evaluate.detections(df, [20, 52, 93], chunk=6).collect()} == whole
    want = set()
    for lv in (20, 52, 93):
        on = [v > lv * 0.01 for v in x] + [False]
        start = None
        for t, o in enumerate(on):
            if o and start is None:
                start = t
            elif not o and start is not None:
                want |= {(s, lv, start, t - 1) for s in "ab"}
                start = None
    assert whole == want


@pytest.mark.parametrize("chunk", [8, 64, 8192])
def test_counts_of_all_buffers(spark, chunk):
    """Look-ups by chunks count what intervals widened by each buffer do."""
    rng = random.Random(chunk)
    rows = [(s, t, rng.choice((0.05, 0.1, 0.5, 0.9)) if rng.random() < 0.7 else rng.random(), int(rng.random() < share)) for s, n, share in (("a", 400, 0.02), ("b", 150, 0.4), ("c", 90, 0.0), ("d", 700, 0.004)) for t in range(n)]
    s = spark.createDataFrame([*rows, ("e", 0, 0.5, 1)], "series_id string, t long, score double, is_anomaly int")
    true, found = evaluate.sequences(s).localCheckpoint(), evaluate.detections(s).localCheckpoint()
    as_rows = lambda df: sorted((r["series_id"], r["buffer"], r["lv"], r["tp"], r["fp"], r["fn"]) for r in df.collect())
    got = evaluate.counts_buffered(found, true, chunk)
    assert as_rows(got) == as_rows(evaluate.counts(found, evaluate.widened(true, s), ["buffer"]))


def test_a_trigger_that_runs_again(spark, tmp_path):
    """The loop's tables stay the same when its last trigger is run a second time; short series wait for their rows."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(hours=i), 1, "up" if i % 2 else "flat", float(i if i % 2 else 5 + i % 3), None) for i in range(120)] + [(500, t0, 1, "few", 1.0, None), (501, t0, 1, "few", None, None)]
    df = spark.createDataFrame(rows, jobs.SCHEMA.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    run = loop.VersionLoop(spark, str(tmp_path), loop.Settings(training=10, shift=1.0))
    parts = [df.where(F.floor(F.dayofmonth("ts") / 3) == k) for k in range(2)]
    for i, part in enumerate(parts):
        run.trigger(part, i)
    first = sorted(map(str, loop.tree_report(run).collect()))
    run.trigger(parts[1], 1)
    assert sorted(map(str, loop.tree_report(run).collect())) == first
    found = {(r["series_id"], r["strategy"], r["version"]): (r["parent"], r["lineage"]) for r in loop.tree_report(run).collect()}
    assert found["up", "chain", 1] == (0, "0>1") and ("few", "chain", 0) not in found and ("flat", "chain", 1) not in found


def test_late_rows_come_in_order(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, t0 + datetime.timedelta(hours=7 * i), 1, f"s{i % 2}", None if i == 9 else float(i), None) for i in range(40)]
    schema = jobs.SCHEMA.replace("timestamp_ntz", "timestamp")
    files = [rows[5:20:2] + [rows[3]], rows[0:20:2] + rows[20:32], rows[32:] + [rows[1]], [(99, t0 + datetime.timedelta(days=60), 1, "", 0.0, None)], [(98, t0 + datetime.timedelta(days=61), 1, "", 0.0, None)], [rows[7]]]
    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with loop.rocks(spark):
        out = loop.in_order(stream, "10 days")
        got = jobs.finished(out, str(tmp_path)).collect()
    # the last file comes behind the watermark
    assert sorted(r["event_id"] for r in got) == sorted({r[0] for f in files[:3] for r in f})
    assert {r["event_id"]: r["value"] for r in got}[9] is None


def test_a_trigger_reads_the_stream_once(spark, tmp_path):
    """Whatever stands behind a trigger's rows, state included, runs once, however many tables are made of them."""
    t0, seen = datetime.datetime(2024, 1, 1), spark.sparkContext.accumulator(0)
    spark.createDataFrame([(i, t0 + datetime.timedelta(hours=i), 1, "s", float(i), None) for i in range(80)], jobs.SCHEMA).write.parquet(str(tmp_path / "events.parquet"))

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    stream = jobs.event_stream(spark, str(tmp_path)).withColumn("value", noted("value"))
    assert jobs.rolling_scores(stream, str(tmp_path), 10).count() == 71
    assert seen.value == 80


def test_lags_from_one_matrix(spark):
    """Residual sums are those of least squares on the same rows, in chunks or not; forecasts leave those residuals."""
    rng = np.random.default_rng(8)
    x = np.zeros((300, 2))
    for t in range(2, 300):
        x[t] = x[t - 1] @ [[0.5, 0.2], [-0.3, 0.1]] + x[t - 2] @ [[0.0, 0.3], [0.2, 0.0]] + rng.normal(0, 0.5, 2)
    df = spark.createDataFrame([("s", t, v.tolist()) for t, v in enumerate(x)] + [("flat", t, [1.0, float(t % 2)]) for t in range(60)], "series_id string, t long, values array<double>")
    z = lags.standardised(df, 2)
    out = {}
    for chunk in (37, 8192):
        c = lags.lag_criteria(lags.lag_products(z, 5, chunk), 5, 2)
        out[chunk] = {(r["series_id"], r["lag"]): r for r in c.collect()}
    assert out[37].keys() == out[8192].keys() and not any(s == "flat" for s, _ in out[37])
    y = (x - x.mean(0)) / x.std(0)
    for p in range(6):
        design = np.concatenate([np.ones((295, 1)), *[y[5 - i : 300 - i] for i in range(1, p + 1)]], 1)
        rest = y[5:] - design @ np.linalg.lstsq(design, y[5:], rcond=None)[0]
        aic = np.linalg.slogdet(rest.T @ rest / 295)[1] + 2 * (4 * p + 2) / 295
        for chunk in out:
            r = out[chunk]["s", p]
            assert r["rss"] == pytest.approx((rest**2).sum()) and r["aic"] == pytest.approx(aic)
    best = next(r for r in out[37].values() if r["chosen"])
    assert best["lag"] == min(range(6), key=lambda p: out[37]["s", p]["aic"])
    c = spark.createDataFrame(list(out[37].values()), "series_id string, lag int, rss double, aic double, chosen boolean, weights array<array<double>>")
    errors = lags.lag_forecast(z, c, 5).select("error").collect()
    assert len(errors) == 295 and sum(v * v for r in errors for v in r["error"]) == pytest.approx(best["rss"])


def test_online_weights(spark):
    rng = random.Random(9)
    x = [rng.gauss(0, 1) for _ in range(120)]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)] + [("b", 0, 1.0)], "series_id string, t long, value double")
    got = {r["t"]: (r["pred"], r["weights"]) for r in frames.online_forecast(df, 3, 16).collect()}
    d = [None, *[b - a for a, b in zip(x, x[1:], strict=False)]]
    for t in range(4, 120):
        past = [u for u in range(4, t // 16 * 16)]
        m = np.asarray([[d[u - i] for i in (1, 2, 3)] for u in past]).reshape(-1, 3)
        w = np.linalg.solve(m.T @ m + np.eye(3), m.T @ np.asarray([d[u] for u in past]))
        assert got[t][1] == pytest.approx(w.tolist()) and got[t][0] == pytest.approx(x[t - 1] + sum(w[i - 1] * d[t - i] for i in (1, 2, 3)))
    assert sorted(got) == list(range(4, 120))


def test_later_anomalies_win(spark):
    df = spark.createDataFrame([("a", t, float(t % 5)) for t in range(400)], "series_id string, t long, value double")
    events = spark.createDataFrame([("a", 50), ("a", 60), ("b", 10)], "series_id string, at long")
    each = training.anomalies_after(df, events)
    assert {(r["at"], r["first"]): r["count"] for r in each.groupBy("at", "first").count().collect()} == {(50, 140): 20, (60, 150): 20}
    last = {r["t"]: r["replacement"] for r in training.last_overlay(each).collect()}
    made = {(r["at"], r["t"]): r["replacement"] for r in each.collect()}
    assert last == {t: made[60 if t >= 150 else 50, t] for t in range(140, 170)}
    assert {r["t"]: r["value"] for r in training.overlaid(df, training.last_overlay(each)).collect()} == {t: last.get(t, float(t % 5)) for t in range(400)}


def test_forest_rows(spark):
    """Walks follow the node table, a far point scores highest, and only trees that are voted out are grown anew."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (200, 2))
    x[77] = (9, -9)
    points = spark.createDataFrame([("s", t, v.tolist()) for t, v in enumerate(x)] + [("one", 0, [1.0, 1.0])], "series_id string, t long, x array<double>")
    nodes = forest.grow(points, forest.first_trees(points, 20), 2, 32)
    table = {(r["series_id"], r["tree"], r["node"]): r for r in nodes.collect()}
    depth = forest.depths(points, nodes, 32)
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    got = {(r["series_id"], r["tree"], r["t"]): r["depth"] for r in depth.collect()}
    assert len(got) == 20 * 201
    for (s, tree, t), d in got.items():
        node, passed, v = 1, 0, x[t] if s == "s" else (1.0, 1.0)
        while (s, tree, node) in table and table[s, tree, node]["normal"] is not None:
            r = table[s, tree, node]
            node, passed = 2 * node + (r["normal"][0] * v[0] + r["normal"][1] * v[1] > r["threshold"]), passed + 1
        assert d == pytest.approx(passed + c(table[s, tree, node]["n"] if (s, tree, node) in table else 0))
    for (s, tree, node), r in table.items():
        if r["normal"] is not None:
            assert r["n"] == sum(table[s, tree, k]["n"] for k in (2 * node, 2 * node + 1) if (s, tree, k) in table)
    scored = forest.tree_scores(depth, 32)
    top = forest.forest_scores(scored).where("series_id = 's'").orderBy(F.desc("score")).first()
    assert top["t"] == 77
    votes = forest.tree_votes(scored, 0.5)
    total = {r["tree"]: r["votes"] for r in votes.where("series_id = 's'").collect()}
    assert set(total) == set(range(20)) and all(abs(v) <= 200 for v in total.values())
    bad = spark.createDataFrame([("s", 3, 0, -1), ("s", 4, 0, 5)], "series_id string, tree int, generation int, votes long")
    new = forest.renew(points, nodes, bad, 2, 32)
    kinds = {(r["series_id"], r["tree"], r["generation"]) for r in new.select(*forest.TREE).distinct().collect()}
    assert kinds == {(s, k, int(s == "s" and k == 3)) for s in ("s", "one") for k in range(20)}


def test_folders_and_switches(spark, tmp_path):
    s = spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.6)], "series_id string, t long, confidence double")
    for run in ("r2", "r1"):
        store.write_scores(s, str(tmp_path / "x"), "diff", "sw_ks", "cl", run)
    got = store.read_scores(spark, str(tmp_path / "x"), schema="t long, confidence double", keep=F.col("series_id") == "b").collect()
    assert [(r["series_id"], r["run"], r["confidence"]) for r in got] == [("b", "r1", 0.6)]
    names = spark.createDataFrame([("a", "usad", "sw_ks", None, "r1"), ("a", "usad", "ares_al_ks", None, "r1"), ("a", "usad", "sw_ks", "al", "r2")], "series_id string, model string, strategy string, score_kind string, run string")
    folders = sorted(r["folder"] for r in store.weight_folders(names, "/w").collect())
    assert folders == ["/w/a/usad-ares_al_ks-al/r1", "/w/a/usad-sw_ks-al/r1", "/w/a/usad-sw_ks-al/r2", "/w/a/usad-sw_ks-avg/r1", "/w/a/usad-sw_ks-cl/r1"]
    checks = spark.createDataFrame([("a", 1, 0.0, 1.0, 1.0)], "series_id string, t long, mu_shift double, sigma double, sigma0 double")
    assert not training.mu_sigma_drift(checks).first()["drift"] and training.mu_sigma_drift(checks, force=True).first()["drift"]


def _aware_plainly(first, scores_, n, step):
    """One batch after the other, as lists: (row, from, until)."""
    reservoir, out = dict(first), {t: [n - 1, None] for t in first}
    for k in range((len(scores_) - n) // step):
        rows = [t for t in range(n + k * step, n + (k + 1) * step) if scores_[t] is not None]
        old, at, come = sorted(reservoir, key=lambda t: (reservoir[t], t)), n + (k + 1) * step - 1, []
        for t in rows:
            if len(come) < n and scores_[t] > reservoir[old[len(come)]]:
                come.append(t)
        for gone, t in zip(old, come, strict=False):
            out[gone][1] = at
            out[t] = [at, None]
        reservoir = {t: reservoir[t] for t in old[len(come) :]} | {t: scores_[t] for t in come}
    return {(t, a, b) for t, (a, b) in out.items()}


@pytest.mark.parametrize(("chunk", "fan"), [(16, 2), (40, 3), (8192, 16)])
def test_aware_reservoir_as_one_batch_after_the_other(spark, chunk, fan):
    n, step, rng = 12, 5, random.Random(8)
    raw = {
        "mixed": [rng.choice([None, float("nan"), 0.1, 0.5, rng.random(), rng.random()]) for _ in range(203)],
        "falling": [1 - i / 300 for i in range(300)],  # priorities rise, so much is let in
        "alike": [0.5] * 100,
        "short": [0.5] * 11,
        "just": [0.5] * 12,
        "unscored": [None] * 60,
    }
    df = spark.createDataFrame([(s, t, x, "extra") for s, xs in raw.items() for t, x in enumerate(xs)] + [(None, 0, 0.5, "extra")], "series_id string, t long, score double, k string")
    got = held.aware_writes(df, n, step, chunk=chunk, fan=fan).collect()
    u = lambda seed, s, k: int(__import__("hashlib").md5(f"{seed}|{s}|{k}".encode()).hexdigest()[:8], 16) / 2**32
    priority = lambda s, t, x: round((0.7 + 0.2 * u(42, s, t)) ** (3 / math.exp(-3 * x)), 9)
    assert {r["series_id"] for r in got} == set(raw) - {"short"}
    for s in set(raw) - {"short"}:
        first = {t: priority(s, t, u(43, s, t)) for t in range(n)}
        later = [None if x is None or math.isnan(x) else priority(s, t, x) for t, x in enumerate(raw[s])]
        assert {(r["t"], r["from_t"], r["until_t"]) for r in got if r["series_id"] == s} == _aware_plainly(first, later, n, step), s
    assert not held.aware_writes(df.limit(0), n, step).count()
    with pytest.raises(ValueError, match="batch"):
        held.aware_writes(df, 4, 5)


def test_a_lower_reservoir_stays_lower():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        n, rows = int(rng.integers(1, 7)), int(rng.integers(1, 30))
        low = rng.integers(0, 9, n).astype(float)
        high = np.sort(low) + rng.integers(0, 4, n)
        p, t, k = rng.integers(0, 12, rows).astype(float), np.arange(rows), np.arange(rows) // n
        bounds = [[least for _, _, least, _, _ in held.through_batches(p, t, k, x, np.arange(-n, 0))] for x in (np.full(n, -np.inf), low, high)]
        assert all(a <= b <= c for a, b, c in zip(*bounds, strict=True))


@pytest.mark.parametrize("chunk", [16, None])
def test_confidence_of_held(spark, chunk):
    rng, n = random.Random(9), 10
    nc = [(s, t, None if rng.random() < 0.05 and t > 40 else float(rng.randrange(6))) for s in "ab" for t in range(90)] + [("short", t, 1.0) for t in range(5)]
    df = spark.createDataFrame(nc, "series_id string, t long, nc double")
    writes = training.reservoir_writes(df, n, 4)
    value, spans = {(s, t): x for s, t, x in nc}, writes.collect()
    want = {}
    for s, t, x in nc:
        now = [value[w["series_id"], w["t"]] for w in spans if w["series_id"] == s and w["from_t"] < t and (w["until_t"] is None or t <= w["until_t"])]
        if now:
            assert len(now) == n
            want[s, t] = None if x is None else sum(y is not None and y >= x for y in now) / n
    got = held.confidence_of_held(df, writes, n, chunk=chunk).collect()
    assert {(r["series_id"], r["t"]): r["confidence"] for r in got} == want and len(got) == len(want) == 160
    assert not held.confidence_of_held(df.limit(0), writes.limit(0), n).count()


@pytest.mark.parametrize("kind", ["ks", "mu_sigma", "forced"])
def test_drift_of_held_sets(spark, kind):
    n, length, every, rng = 30, 4, 2, np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(3, 1, (150, 2)), rng.normal(3, [1, 6], (300, 2))])
    series = {"moves": x, "stays": np.ones((200, 2)), "short": x[:20], "once full": x[: n + length - 1]}
    vectors = {s: [v[i : i + length].T for i in range(len(v) - length + 1)] for s, v in series.items()}
    df = spark.createDataFrame([(s, t, v.tolist(), "extra") for s, vs in vectors.items() for t, v in enumerate(vs)], "series_id string, t long, fv array<array<double>>, d string")
    writes = training.reservoir_writes(df, n, 10)
    rows, want = writes.collect(), []
    bound = math.sqrt(2 / n * math.log(2 / 0.05))
    for s in vectors:
        mine = [w for w in rows if w["series_id"] == s]
        at = sorted({w["from_t"] for w in mine})
        held_at = lambda a: np.stack([vectors[s][w["t"]] for w in mine if w["from_t"] <= a and (w["until_t"] is None or w["until_t"] > a)])
        then, version = held_at(at[0]) if at else None, 0
        for nth, a in list(enumerate(at))[every::every]:
            now = held_at(a)
            assert len(now) == n
            d = max(online.ks_statistic(now[:, c].ravel(), then[:, c].ravel()) for c in (0, 1))
            norm = lambda v: math.sqrt(np.maximum(v, 1e-6).sum())
            shift, sigma, sigma0 = np.sqrt(((now.mean(0) - then.mean(0)) ** 2).sum()), norm(now.var(0, ddof=1)), norm(then.var(0))
            drift = {"ks": d > bound, "mu_sigma": bool(shift > sigma0 or not sigma0 / 2 <= sigma <= 2 * sigma0), "forced": True}[kind]
            version += drift
            want.append((s, a, nth, pytest.approx(d), pytest.approx(shift), pytest.approx(sigma), pytest.approx(sigma0), drift, version))
            then = now if drift else then
    got = held.drift_of_held(df, writes, n, every, "ks" if kind == "forced" else kind, force=kind == "forced")
    assert [tuple(r) for r in got.orderBy("series_id", "upto").collect()] == sorted(want, key=lambda r: r[:2])
    assert {"moves", "stays"} == {r[0] for r in want} and any(r[7] for r in want)
    assert not held.drift_of_held(df.limit(0), writes.limit(0), n, every).count()
    with pytest.raises(ValueError, match="kind"):
        held.drift_of_held(df, writes, n, every, "other")
