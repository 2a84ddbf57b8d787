"""Range-based evaluation of scores against labelled intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.frames import CHUNK, rolling

LEVELS = 100
BUFFERS = tuple(range(0, 201, 20))


def level(k: Column) -> Column:
    return k * F.lit(0.01)


def sequences(series: DataFrame, label: str = "is_anomaly", chunk: int = CHUNK) -> DataFrame:
    """(series_id, k, s, e): the maximal runs of label 1, numbered from 0. Only the ends of runs are put in order, in
    chunks of a series; what a chunk needs of the others is one row a chunk."""
    ends = rolling(series.select("series_id", "t", label), 1, {"before": lambda w: F.lag(label, 1, 0).over(w), "behind": lambda w: F.lead(label, 1, 0).over(w)}, after=1)
    first, last = F.col("before") != 1, F.col("behind") != 1
    each = ends.where((F.col(label) == 1) & (first | last)).select("series_id", "t", first.alias("first"), last.alias("last"))
    return runs(each, ["series_id"], chunk).select("series_id", "k", "s", "e")


def runs(each: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """(keys, k, s, e): runs from the rows (keys, t, first, last) where one starts or ends, numbered from 0 by their start.
    Each start is followed by its end; rows are put in order in chunks of t, and of the other chunks each needs how many
    runs start before it and the first row behind it."""
    each = each.withColumn("_chunk", F.floor(F.col("t") / chunk))
    upto = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = each.groupBy(*keys, "_chunk").agg(F.count_if("first").alias("_n"), F.min("t").alias("_t"))
    chunks = chunks.select(*keys, "_chunk", (F.sum("_n").over(upto) - F.col("_n")).alias("_ahead"), F.lead("_t").over(upto).alias("_next"))
    by = Window.partitionBy(*keys, "_chunk").orderBy("t")
    each = each.withColumns({"e": F.when(F.col("last"), F.col("t")).otherwise(F.lead("t").over(by)), "k": F.count_if("first").over(by) - 1}).where("first")
    return each.join(chunks, [*keys, "_chunk"]).select(*keys, (F.col("_ahead") + F.col("k")).alias("k"), F.col("t").alias("s"), F.coalesce("e", "_next").alias("e"))


SEQUENCES_SQL = """k AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY min(t)) - 1 AS k, min(t) AS s, max(t) AS e FROM
  (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS g FROM a WHERE is_anomaly = 1) GROUP BY series_id, g)"""


def detections(scored: DataFrame, levels: list[int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(series_id, lv, s, e): the maximal runs of score > lv * 0.01, for each level. A row is spread over the levels at
    which a run starts or ends there only, and those are put in order in chunks of a series."""
    # the numbers of levels below a score and below its neighbours' tell where runs start and end; none is tried for each row
    rows = scored.select("series_id", "t", levels_below("score").alias("m"))
    ends = rolling(rows, 1, {"before": lambda w: F.lag("m", 1, 0).over(w), "behind": lambda w: F.lead("m", 1, 0).over(w)}, after=1)
    ends = ends.withColumn("least", F.least("before", "behind")).where("least < m")
    found = F.sequence("least", F.col("m") - 1)
    each = ends.select("series_id", "t", "before", "behind", F.explode(found if levels is None else F.filter(found, lambda k: k.isin(levels))).alias("lv"))
    first, last = (F.col(c) <= F.col("lv") for c in ("before", "behind"))
    return runs(each.select("series_id", "lv", "t", first.alias("first"), last.alias("last")), ["series_id", "lv"], chunk).drop("k")


DETECTIONS_SQL = """lv AS (SELECT unnest(range(100))::INTEGER AS lv),
p AS (SELECT series_id, lv, min(t) AS s, max(t) AS e FROM (SELECT series_id, lv, t, t - row_number() OVER (PARTITION BY series_id, lv ORDER BY t) AS g
  FROM a JOIN lv ON a.score > lv.lv * 0.01::DOUBLE) GROUP BY series_id, lv, g)"""


def overlaps(left: DataFrame, right: DataFrame, how: str = "inner", width: int = 64) -> DataFrame:
    """Rows of two interval tables (series_id, s, e) that overlap; the right columns are s2, e2, k2. Both are cut at
    multiples of width and met by equal cuts; a pair counts where the later start lies."""
    cut = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    l_ = left.withColumn("_cut", cut("s", "e"))
    r = right.select("series_id", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("k").alias("k2")).withColumn("_cut", cut("s2", "e2"))
    touch = (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) & (F.floor(F.greatest("s", "s2") / width) == l_["_cut"])
    return l_.join(r, ["series_id", "_cut"]).where(touch).drop("_cut")


def counts(found: DataFrame, true: DataFrame, extra: list[str] | None = None, width: int = 64) -> DataFrame:
    """(series_id, extra, lv, tp, fp, fn): a detection goes to the first true interval that it overlaps, so a true
    interval is found if some detection goes to it, and a detection is false if it goes to none."""
    extra = extra or []
    cut = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    goals = true.select("series_id", *extra, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("k").alias("k2"), cut("s", "e").alias("_cut"))
    totals = true.groupBy("series_id", *extra).agg(F.count("*").alias("n"))
    all_ = found.join(totals.select("series_id", *extra), "series_id") if extra else found
    pairs = all_.withColumn("_cut", cut("s", "e")).join(goals, ["series_id", *extra, "_cut"], "left")
    hit = F.when((F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")), F.col("k2"))
    to = pairs.groupBy("series_id", *extra, "lv", "s", "e").agg(F.min(hit).alias("goal"))
    sums = to.groupBy("series_id", *extra, "lv").agg(F.countDistinct("goal").alias("tp"), F.sum(F.col("goal").isNull().cast("long")).alias("fp"))
    spark = found.sparkSession
    grid = totals.crossJoin(F.broadcast(spark.range(LEVELS).select(F.col("id").cast("int").alias("lv"))))  # 100 rows a series
    out = grid.join(sums, ["series_id", *extra, "lv"], "left").fillna(0, ["tp", "fp"])
    return out.withColumn("fn", F.col("n") - F.col("tp")).drop("n")


def counts_buffered(found: DataFrame, true: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(series_id, buffer, lv, tp, fp, fn): counts of detections against true intervals (as sequences gives them) with each
    buffer's half added on both sides. Detections lie within the rows of the series, so the ends of the series do not cut.

    Ends of true intervals rise with their numbers, so what a detection goes to is the first one that ends at or behind
    the detection's start less the half, if that one starts early enough: a look-up in the ends, for all buffers at once,
    so no detection is spread by buffers or cuts. Chunks of detections meet the few intervals that they can go to, side by
    side. Goals rise with the detections, so of a chunk only the first goal can be one of the chunks before.
    """
    far, key = np.iinfo(np.int64).max, f"series_id {found.schema['series_id'].dataType.simpleString()}"
    ends = rolling(true.select("series_id", F.col("k").alias("t"), "s", "e"), 1, {"_before": lambda w: F.lag("e", 1, -1).over(w)}, chunk=chunk)
    reach = F.sequence(F.floor((F.col("_before") + 1) / chunk), F.floor((F.col("e") + BUFFERS[-1] // 2) / chunk))
    goals = ends.select(F.col("series_id").alias("_of"), F.explode(reach).alias("_cut"), F.col("t").alias("k"), "s", "e")

    def tallies(key: tuple, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        own, met, out = own.sort_values(["lv", "s"]), met.sort_values("k"), []
        lv, s, e = (own[c].to_numpy() for c in ("lv", "s", "e"))
        k, s2, e2 = (np.append(met[c].to_numpy(np.int64), x) for c, x in (("k", -1), ("s", far), ("e", far)))
        starts = np.flatnonzero(np.diff(lv, prepend=-1)).tolist()
        for b in BUFFERS:
            at = np.searchsorted(e2, s - b // 2)
            goal = np.where(s2[at] <= e + b // 2, k[at], -1)
            for lo, hi in zip(starts, [*starts[1:], len(lv)], strict=False):
                hit = goal[lo:hi][goal[lo:hi] >= 0]
                ends_ = (int(hit[0]), int(hit[-1])) if len(hit) else (-1, -1)
                out.append((key[0], key[1], b, int(lv[lo]), len(np.unique(hit)), hi - lo - len(hit), *ends_))
        return pd.DataFrame(out, columns=["series_id", "_chunk", "buffer", "lv", "tp", "fp", "_first", "_last"])

    each = found.select("series_id", F.floor(F.col("s") / chunk).alias("_chunk"), "lv", "s", "e").groupBy("series_id", "_chunk").cogroup(goals.groupBy("_of", "_cut"))
    each = each.applyInPandas(tallies, f"{key}, _chunk long, buffer int, lv int, tp long, fp long, _first long, _last long")
    before = Window.partitionBy("series_id", "buffer", "lv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    again = F.when((F.col("tp") > 0) & (F.col("_first") == F.max("_last").over(before)), 1).otherwise(0)
    sums = each.withColumn("tp", F.col("tp") - again).groupBy("series_id", "buffer", "lv").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    n = true.groupBy("series_id").agg(F.count("*").alias("n"))
    spread = lambda values, name: F.explode(F.array(*[F.lit(x) for x in values])).alias(name)
    grid = n.select("*", spread(BUFFERS, "buffer")).select("*", spread(range(LEVELS), "lv"))
    out = grid.join(sums, ["series_id", "buffer", "lv"], "left").fillna(0, ["tp", "fp"])
    return out.withColumn("fn", F.col("n") - F.col("tp")).drop("n")


def precision_recall(counted: DataFrame) -> DataFrame:
    one = lambda c: F.greatest(c, F.lit(1))
    return counted.withColumns({"precision": F.col("tp") / one(F.col("tp") + F.col("fp")), "recall": F.col("tp") / one(F.col("tp") + F.col("fn"))})


def area(curve: DataFrame, keys: list[str], factor: float = 0.5) -> DataFrame:
    """keys, area: by trapezes over the points in order of recall, then level; best: the first level with the largest
    precision**2 + recall**2."""
    w = Window.partitionBy(*keys).orderBy("recall", "lv")
    step = (F.col("precision") + F.lag("precision").over(w)) * (F.col("recall") - F.lag("recall").over(w))
    merit = F.round(F.col("precision") * F.col("precision") + F.col("recall") * F.col("recall"), 9)
    each = curve.withColumns({"step": step, "merit": merit})
    return each.groupBy(*keys).agg((F.coalesce(F.sum("step"), F.lit(0.0)) * F.lit(factor)).alias("area"), F.max_by("lv", F.struct("merit", -F.col("lv"))).alias("best"))


def volume(areas: DataFrame) -> DataFrame:
    """series_id, vus: from the doubled areas of the buffers."""
    w = Window.partitionBy("series_id").orderBy("buffer")
    part = (F.col("area") + F.lag("area").over(w)) * (F.col("buffer") - F.lag("buffer").over(w)) / F.lit(float(max(BUFFERS)))
    return areas.withColumn("part", part).groupBy("series_id").agg((F.sum("part") / 4).alias("vus"))


def widened(true: DataFrame, scored: DataFrame) -> DataFrame:
    """true with each buffer's half added on both sides, within the series."""
    last = scored.groupBy("series_id").agg(F.max("t").alias("last"), F.min("t").alias("first"))
    half = (F.col("buffer") / 2).cast("int")
    b = F.explode(F.array(*[F.lit(x) for x in BUFFERS])).alias("buffer")
    return true.select("*", b).join(last, "series_id").select("series_id", "buffer", "k", F.greatest(F.col("s") - half, "first").alias("s"), F.least(F.col("e") + half, "last").alias("e"))


def soft_labels(scored: DataFrame, true: DataFrame) -> DataFrame:
    """(series_id, buffer, t, y, soft, score): labels that fall off on both sides of each interval; where intervals reach
    into each other the later one counts.

    The later one is that with the last start at most half a buffer ahead, or, without one, that with the last end at or
    behind the row: running maxima over rows, looked up that far ahead, find both, so nothing is spread by buffers before
    the sums and no frame is gone through for each row. t must have no gaps.
    """
    mark = lambda at, name: F.struct(F.col(at).alias("t"), F.lit(name).alias("what"))
    marks = true.select("series_id", F.explode(F.array(mark("s", "s"), mark("e", "e"))).alias("x")).groupBy("series_id", F.col("x.t").alias("t"))
    marks = marks.agg(*[F.bool_or(F.col("x.what") == c).alias(f"_{c}") for c in "se"])
    rows = scored.select("series_id", "t", "score", F.col("is_anomaly").alias("y")).join(marks, ["series_id", "t"], "left")
    upto, whole = lambda w: w.rowsBetween(Window.unboundedPreceding, 0), lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.when(F.col("_s"), F.col("t"))
    so_far = {"_more": lambda w: F.lead("t").over(w), "_end": lambda w: F.max(F.when(F.col("_e"), F.col("t"))).over(upto(w)), "_start": lambda w: F.max(start).over(upto(w)), "_top": lambda w: F.max(start).over(whole(w))}
    ahead = {f"_start{b}": lambda w, b=b: F.when(F.lead("t", b // 2).over(w).isNull(), F.col("_top")).otherwise(F.lead("_start", b // 2).over(w)) for b in BUFFERS if b}

    def soft(b: int) -> Column:
        y, t, start, end = F.col("y").cast("double"), F.col("t"), F.col(f"_start{b}"), F.col("_end")
        if not b:
            return y
        behind = F.col("_more").isNotNull() & (t < end + b // 2)
        return F.when(start > t, F.sqrt(1 - (start - t) / F.lit(b))).when(behind, F.sqrt(1 - (t - end) / F.lit(b))).otherwise(y)

    each = F.explode(F.array(*[F.struct(F.lit(b).alias("buffer"), soft(b).alias("soft")) for b in BUFFERS])).alias("x")
    out = rolling(rows, BUFFERS[-1] // 2, [so_far, ahead], BUFFERS[-1] // 2).select("series_id", "t", "y", "score", each)
    return out.select("series_id", "x.buffer", "t", "y", "x.soft", "score")


SOFT_SQL = """bu AS (SELECT unnest(range(0, 201, 20))::INTEGER AS b), g AS (SELECT series_id, max(t) AS last, min(t) AS first FROM a GROUP BY series_id),
m AS (SELECT a.series_id, b, a.t, max_by(CASE WHEN a.t < s THEN sqrt(1 - (s - a.t) / b) ELSE sqrt(1 - (a.t - e) / b) END, k.k) AS v
  FROM k JOIN bu ON b > 0 JOIN g USING (series_id) JOIN a ON a.series_id = k.series_id AND ((a.t >= greatest(s - b // 2, first) AND a.t < s) OR (a.t >= e AND a.t < least(last, e + b // 2))) GROUP BY ALL),
y AS (SELECT a.series_id, bu.b AS buffer, a.t, a.is_anomaly AS y, coalesce(m.v, a.is_anomaly::DOUBLE) AS soft, a.score FROM a CROSS JOIN bu LEFT JOIN m ON m.series_id = a.series_id AND m.b = bu.b AND m.t = a.t)"""


def levels_below(score: str) -> Column:
    """How many levels a score is above; 0 for none, all for NaN."""
    near = F.greatest(F.ceil(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(2.0)) * LEVELS) - 1, F.lit(0))
    above = near + sum((F.col(score) > level(near + i)).cast("int") for i in (0, 1))
    return F.when(F.col(score).isNull(), 0).otherwise(F.least(above, F.lit(LEVELS))).cast("int")


def soft_curve(soft: DataFrame, scored: DataFrame, true: DataFrame) -> DataFrame:
    """(series_id, buffer, lv, tp, fp, precision, recall) of soft labels. A row is predicted at the levels below its
    score, so sums by the number of those levels, cumulated from above, give all 100 levels without spreading rows."""
    by = soft.groupBy("series_id", "buffer", levels_below("score").alias("m")).agg(F.sum("soft").alias("ys"), F.count("*").alias("n"), F.sum(F.col("y") + F.col("soft")).alias("both"))
    # at most one entry a level
    sums = F.map_from_entries(F.collect_list(F.struct("m", F.struct("ys", "n")))).alias("sums")
    p = by.groupBy("series_id", "buffer").agg(F.floor(F.round(F.sum("both") / 2, 9)).alias("pl"), sums)
    grid = p.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).withColumn("at", F.try_element_at("sums", F.col("m"))).drop("sums")
    above = Window.partitionBy("series_id", "buffer").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    c = grid.withColumns({"tp": F.coalesce(F.sum("at.ys").over(above), F.lit(0.0)), "all": F.coalesce(F.sum("at.n").over(above), F.lit(0))})
    peak = overlaps(scored.select("series_id", F.col("t").alias("s"), F.col("t").alias("e"), "score"), true).groupBy("series_id", "k2").agg(F.max("score").alias("peak"))
    lv = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("lv")
    exist = peak.select("series_id", "peak", lv).groupBy("series_id", "lv").agg(F.avg((F.col("peak") > level(F.col("lv"))).cast("double")).alias("existence"))
    c = c.withColumn("lv", F.col("m") - 1).join(exist, ["series_id", "lv"])
    return c.select("series_id", "buffer", "lv", "tp", (F.col("all") - F.col("tp")).alias("fp"), F.round(F.col("tp") / F.greatest(F.col("all"), F.lit(1)), 9).alias("precision"), F.round(F.col("tp") / F.greatest(F.col("pl"), F.lit(1)) * F.col("existence"), 9).alias("recall"))


def nab_sigmoid(y: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(5.0) * y)) - 1


def nab_rewards(scored: DataFrame, true: DataFrame) -> DataFrame:
    """(series_id, t, score, reward, seq): -1 outside; from the start of an interval over twice its length a falling
    sigmoid; seq: the interval that holds the row."""
    last = scored.groupBy("series_id").agg(F.max("t").alias("last"))
    long = true.where("e > s").join(last, "series_id").withColumn("len", F.col("e") - F.col("s"))
    each = long.select("series_id", "k", "s", "e", "len", "last", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("len") - 1)).alias("i"))
    each = each.select("series_id", "k", "i", F.least(F.col("s") + F.col("i"), "last").alias("t"), nab_sigmoid(F.lit(3.0) * F.col("i") / F.col("len") - 3).alias("r"))
    marks = each.groupBy("series_id", "t").agg(F.max_by("r", F.struct("k", "i")).alias("r"))
    inside = true.select("series_id", F.col("k").alias("seq"), F.explode(F.sequence("s", "e")).alias("t"))
    out = scored.join(marks, ["series_id", "t"], "left").join(inside, ["series_id", "t"], "left")
    return out.select("series_id", "t", "score", F.coalesce("r", F.lit(-1.0)).alias("reward"), "seq")


def nab_scores(rewards: DataFrame, true: DataFrame) -> DataFrame:
    """(series_id, lv, nab): per level, the rewards of predicted rows outside intervals and of the first rewarded row
    inside each, over the number of intervals."""
    rewards = rewards.withColumn("m", levels_below("score"))
    below = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("lv")
    out = rewards.where("seq is null").groupBy("series_id", "m").agg(F.sum("reward").alias("r"))
    out = out.where("m > 0").select("series_id", "r", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("lv")).groupBy("series_id", "lv").agg(F.sum("r").alias("r"))
    first = rewards.where("seq is not null and reward > 0 and m > 0").select("series_id", "seq", "t", "reward", below).groupBy("series_id", "seq", "lv").agg(F.min_by("reward", "t").alias("r"))
    first = first.groupBy("series_id", "lv").agg(F.sum("r").alias("r"))
    n = true.groupBy("series_id").agg(F.count("*").alias("n"))
    sums = out.unionByName(first).groupBy("series_id", "lv").agg(F.sum("r").alias("r"))
    grid = n.crossJoin(F.broadcast(rewards.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("lv"))))
    return grid.join(sums, ["series_id", "lv"], "left").select("series_id", "lv", F.round(F.coalesce("r", F.lit(0.0)) / F.col("n"), 6).alias("nab"))


#: An approach's keys, and those with which of its results is evaluated.
KEYS = ("dataset", "model", "strategy", "score_kind")
RESULT_KEYS = (*KEYS, "result")


def aligned(scored: DataFrame, labels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(series_id, t, score, is_anomaly) of written scores (keys, t, score) and labels (dataset, t, is_anomaly), for the
    functions above; series_id is the struct of the keys.

    Scores meet the labels of the same row from their first one on, as far as both go. Approaches that score by
    confidence levels and data sets whose labels are all equal are left out; so are rows without a score.
    """
    varied = labels.groupBy("dataset").agg(F.min("is_anomaly").alias("lo"), F.max("is_anomaly").alias("hi")).where("lo < hi").select("dataset")
    rows = scored.where((F.col("score_kind") != "cl") & F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.join(labels.join(varied, "dataset", "left_semi").select("dataset", "t", "is_anomaly"), ["dataset", "t"])
    return rows.select(F.struct(*keys).alias("series_id"), "t", "score", "is_anomaly")


def approach_results(rows: DataFrame, write: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, area, best, vus, nab, nab_level: every approach's curve, volume under the curves of soft labels and
    early-detection score, over all its aligned rows, all at once; with RESULT_KEYS for anomaly and nonconformity scores
    side by side. write keeps rows and their runs, which several measures read."""
    rows = write(rows)
    true = write(sequences(rows))
    curve = area(precision_recall(counts(detections(rows), true)), ["series_id"])
    soft = volume(area(soft_curve(soft_labels(rows, true), rows, true), ["series_id", "buffer"], 1.0))
    nab = nab_scores(nab_rewards(rows, true), true).groupBy("series_id").agg(F.max("nab").alias("nab"), F.max_by("lv", F.struct("nab", -F.col("lv"))).alias("nab_level"))
    out = curve.join(soft, "series_id").join(nab, "series_id")
    return out.select(*[F.col(f"series_id.{k}").alias(k) for k in keys], "area", "best", "vus", "nab", "nab_level")
