"""An extended isolation forest whose trees are rows: grown level by level, walked by joins, voted on and renewed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.math import hash_uniform, hash_uniform_sql
from driftline.sources.store import written

#: Nodes up to which the table of all trees is sent to every task; with more, points meet them by a shuffle.
SENT = 1_000_000
TREE = ["series_id", "tree", "generation"]


def limit_of(size: int) -> int:
    return max(1, math.ceil(math.log2(size)))


def expected(n: Column) -> Column:
    """The depth that n more points would add on average."""
    return F.when(n > 2, 2 * (F.log(n - 1.0) + 0.5772156649) - 2 * (n - 1.0) / n).when(n == 2, 1.0).otherwise(0.0)


def expected_sql(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def first_trees(series: DataFrame, trees: int) -> DataFrame:
    """TREE: the trees of a forest before any is renewed."""
    return series.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("generation"))


def grow(points: DataFrame, trees: DataFrame, channels: int, size: int = 256, seed: int = 42) -> DataFrame:
    """(TREE, node, n, normal, threshold): the nodes of each tree; node 1 is the root, and node i's children are 2 i and
    2 i + 1. normal and threshold are null for leaves.

    points: series_id, t (0, 1, .. without gaps) and x, an array of channels without nulls. A tree takes the points at
    `size` hashed positions (those met twice count once), so no point is looked at for trees that don't hold it. All trees
    of all series grow together, a level a step: a node's points give its ranges, its cut has a hashed direction through a
    hashed place in those ranges, and its points go on. Levels are as many as it takes to part `size` points.
    """
    n = points.groupBy("series_id").agg(F.count("*").alias("_n"))
    u = lambda i, *c: hash_uniform(seed + i, *[F.col(x) for x in TREE], *c)
    picks = trees.join(n, "series_id").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    picks = picks.select(*TREE, F.floor(u(0, F.col("_slot")) * F.col("_n")).alias("t")).distinct()
    held = written(picks.join(points.select("series_id", "t", "x"), ["series_id", "t"]).select(*TREE, "x", F.lit(1).alias("node")))
    levels = []
    for level in range(limit_of(size) + 1):
        ranges = held.groupBy(*TREE, "node").agg(F.count("*").alias("n"), *[f(F.col("x")[c]).alias(f"_{k}{c}") for c in range(channels) for k, f in (("lo", F.min), ("hi", F.max))])
        bell = lambda c: F.sqrt(-2.0 * F.log(F.greatest(u(1, F.col("node"), F.lit(c)), F.lit(1e-12)))) * F.cos(2 * math.pi * u(2, F.col("node"), F.lit(c)))
        place = lambda c: F.col(f"_lo{c}") + u(3, F.col("node"), F.lit(c)) * (F.col(f"_hi{c}") - F.col(f"_lo{c}"))
        cut = (F.col("n") > 1) & F.lit(level < limit_of(size))
        nodes = ranges.select(*TREE, "node", "n", F.when(cut, F.array(*[bell(c) for c in range(channels)])).alias("normal"), F.when(cut, F.array(*[place(c) for c in range(channels)])).alias("_place"))
        levels.append(written(nodes.select(*TREE, "node", "n", "normal", _dot(F.col("normal"), F.col("_place")).alias("threshold"))))
        if level < limit_of(size):
            held = written(held.join(levels[-1].where("normal is not null"), [*TREE, "node"]).select(*TREE, "x", (2 * F.col("node") + (_dot(F.col("normal"), F.col("x")) > F.col("threshold")).cast("int")).alias("node")))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return written(out)


def depths(points: DataFrame, nodes: DataFrame, size: int = 256) -> DataFrame:
    """(TREE, t, depth) of every point in every tree of its series: the cuts that it passes, and what the points of the leaf
    would add. Each level is a join by tree and node; a node table of a checked size is sent to all tasks, so a point's
    whole walk is one task's work and nothing of the points moves."""
    sent = (lambda d: F.broadcast(d)) if nodes.count() <= SENT else (lambda d: d)
    walk = points.select("series_id", "t", "x").join(sent(nodes.where("node = 1").select(*TREE)), "series_id").withColumns({"node": F.lit(1), "passed": F.lit(0)})
    cuts = sent(nodes.where("normal is not null").select(*TREE, "node", "normal", "threshold"))
    for _ in range(limit_of(size)):
        on = F.col("normal").isNotNull()
        child = 2 * F.col("node") + (_dot(F.col("normal"), F.col("x")) > F.col("threshold")).cast("int")
        # a point that has come to a leaf meets no cut there and stays
        walk = walk.join(cuts, [*TREE, "node"], "left").select(*TREE, "t", "x", F.when(on, child).otherwise(F.col("node")).alias("node"), (F.col("passed") + on.cast("int")).alias("passed"))
    ends = walk.join(sent(nodes.select(*TREE, "node", "n")), [*TREE, "node"], "left")
    return ends.select(*TREE, "t", (F.col("passed") + expected(F.coalesce("n", F.lit(0)))).alias("depth"))


def tree_scores(depth: DataFrame, size: int = 256) -> DataFrame:
    """depth with score: near 1 for points that few cuts part from the others."""
    return depth.withColumn("score", F.pow(F.lit(2.0), -F.col("depth") / expected(F.lit(float(size)))))


def forest_scores(scored: DataFrame) -> DataFrame:
    """(series_id, t, score): the mean of all trees."""
    return scored.groupBy("series_id", "t").agg(F.avg("score").alias("score"))


def tree_votes(scored: DataFrame, threshold: float) -> DataFrame:
    """(TREE, votes): over all points, those where the tree's verdict (a score over the threshold) is that of the whole
    forest, less the others."""
    whole = forest_scores(scored).select("series_id", "t", (F.round("score", 9) > threshold).alias("_all"))
    vote = F.when((F.round("score", 9) > threshold) == F.col("_all"), 1).otherwise(-1)
    return scored.join(whole, ["series_id", "t"]).groupBy(*TREE).agg(F.sum(vote).alias("votes"))


def renew(points: DataFrame, nodes: DataFrame, votes: DataFrame, channels: int, size: int = 256, seed: int = 42) -> DataFrame:
    """The nodes of the forest in which trees with fewer than no votes are grown anew, as the next generation, from points."""
    out = votes.where("votes < 0").select(*TREE)
    new = grow(points, out.withColumn("generation", F.col("generation") + 1), channels, size, seed)
    return written(nodes.join(out, TREE, "left_anti").unionByName(new))


def forest_sql(trees: int, size: int, seed: int = 42) -> str:
    """Tables up to sc (tree, t, depth, score) for p (t, z0 .. z3), one series called lineitem."""
    u = lambda i, *c: hash_uniform_sql(seed + i, "'lineitem'", "tree", "0", *c)
    bells = ", ".join(f"sqrt(-2.0::DOUBLE * ln(greatest({u(1, 'node', str(c))}, 1e-12))) * cos({2 * math.pi!r}::DOUBLE * {u(2, 'node', str(c))}) AS g{c}, lo{c} + {u(3, 'node', str(c))} * (hi{c} - lo{c}) AS q{c}" for c in range(4))
    ranges = ", ".join(f"min(z{c}) OVER w AS lo{c}, max(z{c}) OVER w AS hi{c}" for c in range(4))
    threshold = " + ".join(f"g{c} * q{c}" for c in range(4))
    side = " + ".join(f"g{c} * z{c}" for c in range(4))
    cuts = lambda held: f"SELECT *, {threshold} AS threshold FROM (SELECT *, {bells} FROM (SELECT h.*, z0, z1, z2, z3, count(*) OVER w AS n, {ranges} FROM {held} h JOIN p ON p.t = h.t WINDOW w AS (PARTITION BY tree, node)))"
    return f"""pk AS (SELECT DISTINCT tree, floor({u(0, 'slot')} * n)::BIGINT AS t FROM range({trees}) a(tree), range({size}) b(slot), (SELECT count(*) AS n FROM p)),
hd AS (SELECT 0 AS lv, tree, t, 1 AS node FROM pk UNION ALL SELECT lv + 1, tree, t, 2 * node + ({side} > threshold)::INT FROM ({cuts("hd")}) WHERE n > 1 AND lv < {limit_of(size)}),
nd AS (SELECT DISTINCT tree, node, n, g0, g1, g2, g3, threshold, n > 1 AND lv < {limit_of(size)} AS cut FROM ({cuts("hd")})),
wk AS (SELECT t, tree, 1 AS node, 0 AS passed FROM p, range({trees}) a(tree)
  UNION ALL SELECT wk.t, wk.tree, 2 * wk.node + ({side} > threshold)::INT, passed + 1 FROM wk JOIN nd ON nd.tree = wk.tree AND nd.node = wk.node AND cut JOIN p ON p.t = wk.t),
en AS (SELECT t, tree, max(passed) AS passed, arg_max(node, passed) AS node FROM wk GROUP BY ALL),
dp AS (SELECT en.t, en.tree, passed + {expected_sql("coalesce(n, 0)")} AS depth FROM en LEFT JOIN nd ON nd.tree = en.tree AND nd.node = en.node),
sc AS (SELECT *, pow(2.0::DOUBLE, -depth / ({expected_sql(str(size))})) AS score FROM dp)"""
