"""Networks as rows, against plain sequential training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import nets

VERSIONS = "series_id string, version int, from_t long, fork boolean"
VECTORS = "series_id string, t long, fv array<double>"


@pytest.mark.parametrize("net", [nets.autoencoder(5, 4), nets.usad(6, 2), nets.usad(6, 2, 0.4)])
def test_gradients_are_those_of_small_steps(net):
    rng = np.random.default_rng(3)
    p, x = rng.normal(size=net.starts[-1]) * 0.7, rng.normal(size=(7, net.layers[0][0]))

    def loss(q):
        errors = [net.forward(q, x, k)[-1] - x for k in range(len(net.outputs))]
        return sum(w * (np.abs(e) if net.absolute else e * e).mean(1).sum() for w, e in zip(net.weights, errors, strict=True))

    g = net.gradients(p, x)
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(p + step) - loss(p - step)) / 2e-6, abs=1e-4)
    assert g[-1] == 7


def plain_fit(net, windows, p, epochs, batches, rate, start=None):
    """Adam over steps in order; windows: {t: window}."""
    x = np.array(list(windows.values()))
    mean, sd = x.mean(), x.std() or 1.0
    p, m, v, steps = start or (p, np.zeros_like(p), np.zeros_like(p), 0)
    for epoch in range(epochs):
        losses = np.zeros(len(net.outputs))
        for b in range(batches):
            part = np.array([w for t, w in windows.items() if t % batches == b])
            if not len(part):
                continue
            g = net.gradients(p, (part - mean) / sd)
            losses += g[len(p) : -1]
            g, steps = g[: len(p)] / len(part), steps + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-7)
    return p, m, v, steps, mean, sd, losses


def test_versions_train_as_one_after_the_other(spark, monkeypatch):
    net = nets.usad(8, 2, 0.7)
    monkeypatch.setattr(nets, "BLOCK", 5)
    monkeypatch.setattr(nets, "SPREAD", 2)
    width = net.layers[0][0]
    rng = np.random.default_rng(5)
    data = {s: {t: rng.normal(size=width) * 3 + i for t in range(10, 70)} for i, s in enumerate("ab")} | {"flat": {t: np.ones(width) for t in range(10, 40)}}
    rows = [(s, t, w.tolist()) for s, x in data.items() for t, w in x.items()]
    odd = [("a", 70, [float("nan")] * width), ("a", 71, [float("inf")] * width), (None, 3, [1.0] * width), ("late", 90, [1.0] * width)]
    vectors = spark.createDataFrame(rows + odd, VECTORS).withColumn("version", F.lit("clash"))
    plan = [("a", 0, 40, False), ("a", 1, 55, False), ("a", 2, 72, True), ("b", 0, 30, False), ("b", 1, 60, True), ("flat", 0, 35, False), ("late", 0, 50, False), ("late", 1, 95, False), (None, 0, 9, False)]
    versions = spark.createDataFrame(plan, VERSIONS)
    fitted = nets.fit(vectors, versions, nets.sliding_members(versions, 22), net, 2, 2, 0.02)
    got = {(r["series_id"], r["version"]): r for r in fitted.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("flat", 0), ("late", 1)}
    first = {(r["series_id"], r["version"]): np.array(r["p"]) for r in versions.select("series_id", "version", nets._first_weights(net, 42).alias("p")).collect()}
    states = {}
    for s, number, at, fork in plan[:6]:
        windows = {t: w for t, w in data[s].items() if at - 22 <= t < at}
        before = states.get((s, number - 1))
        states[s, number] = plain_fit(net, windows, first[s, number], 2, 2, 0.02, before[:4] if before and not fork else None)
        p, _, _, steps, mean, sd, losses = states[s, number]
        r = got[s, number]
        np.testing.assert_allclose(r["p"], p, atol=1e-9)
        assert (r["steps"], r["best"]) == (steps, int(np.argmin(losses)))
        np.testing.assert_allclose([r["mean"], r["sd"]], [mean, sd], atol=1e-9)
    assert states["a", 1][3] == 8 and states["a", 2][3] == 4

    scored = nets.score(vectors, versions, fitted, net).collect()
    assert len(scored) == len({(r["series_id"], r["t"]) for r in scored})
    expected = {(s, t) for s, x in data.items() for t in x if t >= min(p[2] for p in plan if p[0] == s)}
    assert {(r["series_id"], r["t"]) for r in scored} == expected
    for r in scored:
        assert r["version"] == max(n for s, n, at, _ in plan if s == r["series_id"] and at <= r["t"])
        p, _, _, _, mean, sd, losses = states[r["series_id"], r["version"]]
        x = ((data[r["series_id"]][r["t"]] - mean) / sd)[None]
        y = net.forward(p, x, int(np.argmin(losses)))[-1]
        norm = np.linalg.norm(x) * np.linalg.norm(y)
        assert r["nc"] == pytest.approx(1 - (x * y).sum() / max(norm, 1e-12), abs=1e-7)


def test_nothing_to_learn_from(spark):
    net = nets.autoencoder(4, 3)
    vectors, versions = spark.createDataFrame([], VECTORS), spark.createDataFrame([], VERSIONS)
    fitted = nets.fit(vectors, versions, nets.sliding_members(versions, 5), net)
    assert fitted.count() == 0
    assert nets.score(vectors, versions, fitted, net).count() == 0
