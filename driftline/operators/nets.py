"""Networks as rows: each step of training is one Spark job for all series at once. Gradients are sums over the windows of
a training set, so blocks of windows give theirs side by side, and the weights are a row of arrays by series and version."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.math import hash_uniform, hash_uniform_sql
from driftline.operators.registry import cosine_distances
from driftline.operators.training import versions_asof
from driftline.sources.store import written

#: Windows of a block, which weights travel with, and blocks for which a series' weights are copied once.
BLOCK, SPREAD = 64, 64
#: How fast Adam's two means forget, and what keeps it from dividing by nothing.
FORGET, FORGET_SQUARES, TINY = 0.9, 0.999, 1e-7


@dataclass(frozen=True)
class Net:
    """layers: inputs, outputs and whether negative outputs become 0. outputs: the layers that each output runs through,
    from the window on. weights: what each output's loss counts. absolute: the loss is the mean absolute error, not the
    mean squared one. Parameters are a flat array, layer by layer: a row of weights for each output, then the biases."""

    layers: tuple[tuple[int, int, bool], ...]
    outputs: tuple[tuple[int, ...], ...]
    weights: tuple[float, ...]
    absolute: bool = False

    @property
    def starts(self) -> list[int]:
        """Where each layer's parameters start, and where the last one's end."""
        return [0, *np.cumsum([(a + 1) * b for a, b, _ in self.layers]).tolist()]

    def part(self, p: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, _ = self.layers[layer]
        at = self.starts[layer]
        return p[at : at + a * b].reshape(b, a), p[at + a * b : at + (a + 1) * b]

    def forward(self, p: np.ndarray, x: np.ndarray, output: int) -> list[np.ndarray]:
        """x and what each layer on the output's way makes of it."""
        out = [x]
        for layer in self.outputs[output]:
            w, b = self.part(p, layer)
            y = out[-1] @ w.T + b
            out.append(np.maximum(y, 0) if self.layers[layer][2] else y)
        return out

    def gradients(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Sums over the rows of x: of the gradient of each parameter, of each output's loss, and of ones."""
        g = np.zeros(len(p) + len(self.outputs) + 1)
        g[-1] = len(x)
        for k, path in enumerate(self.outputs):
            acts = self.forward(p, x, k)
            error = acts[-1] - x
            g[len(p) + k] = (np.abs(error) if self.absolute else error * error).mean(1).sum()
            if not self.weights[k]:
                continue
            d = self.weights[k] * (np.sign(error) if self.absolute else 2 * error) / x.shape[1]
            for i in range(len(path) - 1, -1, -1):
                if self.layers[path[i]][2]:
                    d = d * (acts[i + 1] > 0)
                gw, gb = self.part(g, path[i])
                gw += d.T @ acts[i]
                gb += d.sum(0)
                d = d @ self.part(p, path[i])[0]
        return g


def autoencoder(length: int, hidden: int = 20) -> Net:
    """One hidden layer; mean absolute error."""
    return Net(((length, hidden, True), (hidden, length, False)), ((0, 1),), (1.0,), True)


def usad(length: int, latent: int, plain: float = 1.0) -> Net:
    """Two decoders on one encoder: outputs of the first, of the second, and of the second on the first's output. Plain
    reconstruction weighs `plain`, the last output 1 - plain."""
    a, b = max(2, length // 2), max(2, length // 4)
    decoder = ((latent, b, True), (b, a, True), (a, length, False))
    layers = ((length, a, True), (a, b, True), (b, latent, True), *decoder, *decoder)
    enc, one, two = (0, 1, 2), (3, 4, 5), (6, 7, 8)
    return Net(layers, ((*enc, *one), (*enc, *two), (*enc, *one, *enc, *two)), (plain, plain, 1 - plain))


def sliding_members(versions: DataFrame, n: int) -> DataFrame:
    """(series_id, version, t): a version's training set, the n windows that end before it holds."""
    return versions.select("series_id", "version", F.explode(F.sequence(F.greatest(F.col("from_t") - n, F.lit(0)), F.col("from_t") - 1)).alias("t"))


def _finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _first_weights(net: Net, seed: int) -> Column:
    """Uniform by series, version and position, within the root of 6 over a layer's inputs and outputs; biases are 0."""

    def value(q: Column) -> Column:
        out = F.lit(0.0)
        for (a, b, _), at in zip(net.layers, net.starts, strict=False):
            u = hash_uniform(seed, F.col("series_id"), F.col("version"), q)
            out = F.when((q >= at) & (q < at + a * b), (u * 2.0 - 1.0) * float(np.sqrt(6 / (a + b)))).otherwise(out)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(net.starts[-1] - 1)), value)


def _spread(state: DataFrame, *columns: str) -> DataFrame:
    """A copy of each series' state for so many of its blocks: a long series' blocks meet it in many tasks."""
    return state.select("series_id", F.explode(F.sequence("_first", "_last")).alias("_salt"), *columns)


def _step(state: DataFrame, blocks: DataFrame, net: Net, rate: float, first: bool) -> DataFrame:
    """state after one step of Adam on the blocks; a series without any stays as it is. first: losses start anew."""
    size, kinds = net.starts[-1], len(net.outputs)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found: dict[str, np.ndarray] = {}
            for key, xs, mean, sd, p in zip(pdf["series_id"], pdf["xs"], pdf["mean"], pdf["sd"], pdf["p"], strict=True):
                g = net.gradients(np.asarray(p), (np.stack(list(xs)) - mean) / sd)
                found[key] = found[key] + g if key in found else g
            yield pd.DataFrame({"series_id": list(found), "g": list(found.values())}, dtype=object)

    each = blocks.join(_spread(state, "mean", "sd", "p"), ["series_id", "_salt"]).select("series_id", "xs", "mean", "sd", "p")
    g = each.mapInPandas(sums, "series_id string, g array<double>").select("series_id", F.posexplode("g").alias("pos", "g"))
    g = g.groupBy("series_id", "pos").agg(F.sum("g").alias("g")).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "g"))).alias("_g"))
    s = state.join(g.select("series_id", F.transform("_g", lambda e: e["g"]).alias("_g")), "series_id", "left")
    s = s.withColumn("_n", F.element_at("_g", -1)).withColumn("_mean", F.transform(F.slice("_g", 1, size), lambda x: x / F.col("_n")))
    s = s.withColumns({
        "_m": F.zip_with("m", "_mean", lambda m, x: m * FORGET + x * (1 - FORGET)),
        "_v": F.zip_with("v", "_mean", lambda v, x: v * FORGET_SQUARES + x * x * (1 - FORGET_SQUARES)),
        "_steps": F.col("steps") + 1,
    })
    unbiased = lambda x, keep: x / (1 - F.pow(F.lit(keep), F.col("_steps")))
    move = F.zip_with("_m", "_v", lambda m, v: unbiased(m, FORGET) / (F.sqrt(unbiased(v, FORGET_SQUARES)) + TINY) * rate)
    new = {"p": F.zip_with("p", move, lambda p, x: p - x), "m": F.col("_m"), "v": F.col("_v"), "steps": F.col("_steps")}
    before = F.array_repeat(F.lit(0.0), kinds) if first else F.col("losses")
    losses = F.coalesce(F.zip_with(before, F.slice("_g", size + 1, kinds), lambda a, b: a + b), before)
    kept = [F.when(F.col("_g").isNull(), F.col(c)).otherwise(x).alias(c) for c, x in new.items()]
    return s.select("series_id", "version", "mean", "sd", "_first", "_last", *kept, losses.alias("losses"))


def fit(vectors: DataFrame, versions: DataFrame, members: DataFrame, net: Net, epochs: int = 5, batches: int = 1, rate: float = 1e-3, seed: int = 42) -> DataFrame:
    """(series_id, version, mean, sd, steps, p, m, v, losses, best): the model of each version, a row each.

    vectors: series_id, t, fv; versions: series_id, version (from 0, in order), from_t, fork; members: series_id, version, t
    of the windows that a version learns from. A version goes on from the weights and the state of the one before; version
    0, and one that is a fork, starts from fresh weights. Windows are scaled by the mean and deviation of their training
    set's values, which the version keeps. An epoch is one pass in `batches` steps, a window's step by its t. best: the
    output with the least loss in the last epoch, the first of equal ones.

    Versions of one number train together, for all series: epochs times batches jobs for each number, whatever the
    series and rows. Windows with a null or infinite value, and rows with a null series_id, teach nothing; a version
    without windows has no row, and the next one starts afresh. Repeated members count as often.
    """
    rows = members.join(vectors.select("series_id", "t", F.col("fv").alias("x")), ["series_id", "t"]).where(_finite(F.col("x")))
    blocks = rows.groupBy("series_id", "version", (F.col("t") % batches).alias("_batch"), F.floor(F.col("t") / BLOCK).alias("_block")).agg(F.collect_list("x").alias("xs"))
    blocks = written(blocks.withColumn("_salt", F.floor(F.col("_block") / SPREAD)).repartition("series_id", "_salt"))  # lies there for all steps
    add = lambda what: F.sum(F.aggregate(F.flatten("xs"), F.lit(0.0), lambda s, x: s + what(x)))
    count = F.sum(F.size(F.flatten("xs")))
    known = blocks.groupBy("series_id", "version").agg(F.min("_salt").alias("_first"), F.max("_salt").alias("_last"), (add(lambda x: x) / count).alias("mean"), (add(lambda x: x * x) / count).alias("_square"))
    var = F.col("_square") - F.col("mean") * F.col("mean")
    known = known.withColumn("sd", F.when(var > F.greatest(F.lit(1.0), F.col("mean") * F.col("mean")) * 1e-12, F.sqrt(var)).otherwise(1.0))
    known = written(known.join(versions.select("series_id", "version", "fork"), ["series_id", "version"]))
    done, zeros = [], F.array_repeat(F.lit(0.0), net.starts[-1])
    fresh = {"p": _first_weights(net, seed), "m": zeros, "v": zeros, "steps": F.lit(0)}
    for number in range((versions.agg(F.max("version")).first()[0] or 0) + 1):
        state = known.where(F.col("version") == number)
        if done:
            old = done[-1].select("series_id", F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in fresh])
            state = state.join(old, "series_id", "left")
            goes_on = F.col("_old").isNotNull() & ~F.coalesce("fork", F.lit(False))
            state = state.withColumns({c: F.when(goes_on, F.col(f"_{c}")).otherwise(x) for c, x in fresh.items()})
        else:
            state = state.withColumns(fresh)
        state = state.select("series_id", "version", "mean", "sd", "_first", "_last", *fresh, F.array_repeat(F.lit(0.0), len(net.outputs)).alias("losses"))
        mine = blocks.where(F.col("version") == number)
        for step in range(epochs * batches):
            state = written(_step(state, mine.where(F.col("_batch") == step % batches), net, rate, step % batches == 0))
        done.append(state)
    best = (F.array_position("losses", F.array_min("losses")) - 1).cast("int")
    return reduce(DataFrame.unionByName, done).withColumn("best", best).drop("_first", "_last")


def score(vectors: DataFrame, versions: DataFrame, fitted: DataFrame, net: Net) -> DataFrame:
    """(series_id, t, version, nc): the cosine distance of each window, as its version scales it, to the best output of the
    version in force at its end. Windows with a null or infinite value, and those before a series' first version, have no
    row."""
    rows = versions_asof(vectors, versions).where("version is not null").join(vectors.select("series_id", "t", F.col("fv").alias("x")), ["series_id", "t"])
    rows = written(rows.where(_finite(F.col("x"))).select("series_id", "version", F.floor(F.col("t") / (BLOCK * SPREAD)).alias("_salt"), "t", "x"))
    reach = rows.groupBy("series_id", "version").agg(F.min("_salt").alias("_first"), F.max("_salt").alias("_last"))
    models = _spread(fitted.join(reach, ["series_id", "version"]), F.col("version").alias("_version"), "mean", "sd", "p", "best").withColumnsRenamed({"series_id": "_of", "_salt": "_group"})
    columns = pa.schema([("series_id", pa.string()), ("t", pa.int64()), ("version", pa.int32()), ("nc", pa.float64())])

    def distances(key: tuple, own: pa.Table, model: pa.Table) -> pa.Table:
        """Some windows that meet their model once: at most BLOCK * SPREAD, however long a series is."""
        if not (own.num_rows and model.num_rows):
            return columns.empty_table()
        mean, sd, p, best = (model.column(c)[0].as_py() for c in ("mean", "sd", "p", "best"))
        x = (own.column("x").combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1) - mean) / sd
        nc = cosine_distances(x, net.forward(np.asarray(p), x, best)[-1])
        same = lambda v, kind: pa.repeat(pa.scalar(v.as_py(), kind), own.num_rows)
        return pa.table([same(key[0], pa.string()), own.column("t"), same(key[1], pa.int32()), pa.array(nc)], schema=columns)

    met = rows.groupBy("series_id", "version", "_salt").cogroup(models.groupBy("_of", "_version", "_group"))
    return met.applyInArrow(distances, "series_id string, t long, version int, nc double")


def _forward_sql(net: Net, output: int, source: str) -> str:
    """source with a1, a2, .., what each layer on the output's way makes of x."""
    for i, layer in enumerate(net.outputs[output]):
        (a, b, rectified), at = net.layers[layer], net.starts[layer]
        y = f"p[{at + a * b + 1} + j] + list_dot_product({f'a{i}' if i else 'x'}, p[{at + 1} + j * {a} : {at} + (j + 1) * {a}])"
        source = f"(SELECT *, list_transform(range({b}), lambda j: {f'greatest(0.0::DOUBLE, {y})' if rectified else y}) AS a{i + 1} FROM {source})"
    return source


def _backward_sql(net: Net, output: int, source: str) -> str:
    """source, with a1, a2, .., and d1, d2, .., the gradient of what each layer gives."""
    path, length = net.outputs[output], net.layers[0][0]
    error = f"a{len(path)}[j] - x[j]"
    source = f"(SELECT *, list_transform(range(1, {length + 1}), lambda j: {net.weights[output]}::DOUBLE * {f'sign({error})' if net.absolute else f'2 * ({error})'} / {length}) AS d{len(path)} FROM {source})"
    for i in range(len(path) - 1, -1, -1):
        (a, b, rectified), at = net.layers[path[i]], net.starts[path[i]]
        if rectified:
            source = f"(SELECT * REPLACE (list_transform(range(1, {b + 1}), lambda j: CASE WHEN a{i + 1}[j] > 0 THEN d{i + 1}[j] ELSE 0.0::DOUBLE END) AS d{i + 1}) FROM {source})"
        if i:
            source = f"(SELECT *, list_transform(range({a}), lambda i: list_sum(list_transform(range({b}), lambda j: d{i + 1}[j + 1] * p[{at + 1} + j * {a} + i]))) AS d{i} FROM {source})"
    return source


def fit_sql(net: Net, versions: int, epochs: int = 5, batches: int = 1, rate: float = 1e-3, seed: int = 42) -> str:
    """From mb (series_id, version, t, x) and ver (series_id, version, from_t, fork), each step a table: up to fitted
    (series_id, version, mean, sd, p, best)."""
    size, kinds = net.starts[-1], len(net.outputs)
    u = hash_uniform_sql(seed, "series_id", "version", "q")
    first = " ".join(f"WHEN q >= {at} AND q < {at + a * b} THEN ({u} * 2 - 1) * {float(np.sqrt(6 / (a + b)))!r}::DOUBLE" for (a, b, _), at in zip(net.layers, net.starts, strict=False))
    zeros = f"list_transform(range({size}), lambda q: 0.0::DOUBLE)"
    none = f"[{', '.join(['0.0::DOUBLE'] * kinds)}]"
    out = [f"""kn AS MATERIALIZED (SELECT series_id, version, fork, mean, CASE WHEN var > greatest(1, mean * mean) * 1e-12 THEN sqrt(var) ELSE 1 END AS sd FROM (
  SELECT series_id, version, sum(list_sum(x)) / sum(len(x)) AS mean, sum(list_dot_product(x, x)) / sum(len(x)) - mean * mean AS var FROM mb GROUP BY ALL) JOIN ver USING (series_id, version)),
sm AS MATERIALIZED (SELECT series_id, version, t % {batches} AS batch, list_transform(x, lambda v: (v - mean) / sd) AS x FROM mb JOIN kn USING (series_id, version))"""]  # fmt: skip
    last = None
    for number in range(versions):
        name = f"s{number}_0"
        fresh = {"p": f"list_transform(range({size}), lambda q: CASE {first} ELSE 0.0::DOUBLE END)", "m": zeros, "v": zeros, "steps": "0"}
        if last:
            fresh = {c: f"CASE WHEN o.series_id IS NOT NULL AND NOT fork THEN o.{c} ELSE {x.replace('series_id', 'kn.series_id').replace('version', 'kn.version')} END" for c, x in fresh.items()}
        source = f"kn LEFT JOIN {last} o ON o.series_id = kn.series_id" if last else "kn"
        out.append(f"{name} AS MATERIALIZED (SELECT kn.series_id, kn.version, kn.mean, kn.sd, {', '.join(f'{x} AS {c}' for c, x in fresh.items())}, {none} AS losses FROM {source} WHERE kn.version = {number})")
        for step in range(epochs * batches):
            new = f"s{number}_{step + 1}"
            batch = f"(SELECT s.series_id, p, x FROM sm JOIN {name} s ON s.series_id = sm.series_id AND s.version = sm.version WHERE batch = {step % batches})"
            grads, losses = [], []
            for k, path in enumerate(net.outputs):
                way = _forward_sql(net, k, batch)
                out.append(f"{new}f{k} AS MATERIALIZED (SELECT * FROM {_backward_sql(net, k, way) if net.weights[k] else way})")
                error = f"a{len(path)}[j] - x[j]"
                value = f"abs({error})" if net.absolute else f"({error}) * ({error})"
                losses.append(f"SELECT series_id, {k} AS k, sum(list_sum(list_transform(range(1, {net.layers[0][0] + 1}), lambda j: {value})) / {net.layers[0][0]}) AS loss, count(*) AS n FROM {new}f{k} GROUP BY series_id")
                for i, layer in enumerate(path if net.weights[k] else ()):
                    cells = f"list_concat(flatten(list_transform(d{i + 1}, lambda d: list_transform({f'a{i}' if i else 'x'}, lambda a: d * a))), d{i + 1})"
                    grads.append(f"SELECT series_id, {net.starts[layer]} + generate_subscripts(g, 1) AS pos, unnest(g) AS g FROM (SELECT series_id, {cells} AS g FROM {new}f{k})")
            out.append(f"{new}g AS MATERIALIZED (SELECT series_id, list(g ORDER BY pos) AS g FROM (SELECT series_id, pos, sum(g) AS g FROM ({' UNION ALL '.join(grads)}) GROUP BY ALL) GROUP BY series_id)")
            out.append(f"{new}l AS MATERIALIZED (SELECT series_id, list(loss ORDER BY k) AS loss, max(n) AS n FROM ({' UNION ALL '.join(losses)}) GROUP BY series_id)")
            loss = "loss" if step % batches == 0 else f"list_transform(range(1, {kinds + 1}), lambda i: losses[i] + loss[i])"
            before = none if step % batches == 0 else "losses"
            over = lambda what: f"list_transform(range(1, {size + 1}), lambda i: {what})"
            move = f"m2[i] / (1 - pow({FORGET}::DOUBLE, steps + 1)) / (sqrt(v2[i] / (1 - pow({FORGET_SQUARES}::DOUBLE, steps + 1))) + {TINY}::DOUBLE) * {rate}::DOUBLE"
            out.append(f"""{new} AS MATERIALIZED (SELECT series_id, version, mean, sd, CASE WHEN g IS NULL THEN p ELSE {over(f'p[i] - {move}')} END AS p, CASE WHEN g IS NULL THEN m ELSE m2 END AS m,
  CASE WHEN g IS NULL THEN v ELSE v2 END AS v, CASE WHEN g IS NULL THEN steps ELSE steps + 1 END AS steps, CASE WHEN g IS NULL THEN {before} ELSE {loss} END AS losses FROM (
  SELECT *, {over(f'm[i] * {FORGET}::DOUBLE + g[i] / n * {1 - FORGET!r}::DOUBLE')} AS m2, {over(f'v[i] * {FORGET_SQUARES}::DOUBLE + (g[i] / n) * (g[i] / n) * {1 - FORGET_SQUARES!r}::DOUBLE')} AS v2
  FROM {name} LEFT JOIN {new}g USING (series_id) LEFT JOIN {new}l USING (series_id)))""")  # fmt: skip
            name = new
        last = name
        out.append(f"fin{number} AS (SELECT series_id, version, mean, sd, p, list_position(losses, list_min(losses)) - 1 AS best FROM {name})")
    return ",\n".join([*out, f"fitted AS ({' UNION ALL '.join(f'SELECT * FROM fin{i}' for i in range(versions))})"])


def score_sql(net: Net) -> str:
    """From wd (series_id, t, x), ver and fitted: nc (series_id, t, version, nc)."""
    met = "(SELECT w.series_id, w.t, f.version, f.p, f.best, list_transform(w.x, lambda v: (v - f.mean) / f.sd) AS x FROM wd w ASOF JOIN ver r ON r.series_id = w.series_id AND w.t >= r.from_t JOIN fitted f ON f.series_id = r.series_id AND f.version = r.version)"
    each = " UNION ALL ".join(f"SELECT series_id, t, version, x, a{len(path)} AS y FROM {_forward_sql(net, k, f'(SELECT * FROM {met} WHERE best = {k})')}" for k, path in enumerate(net.outputs))
    return f"nn AS (SELECT series_id, t, version, 1 - list_dot_product(x, y) / greatest(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 1e-12) AS nc FROM ({each}))"
