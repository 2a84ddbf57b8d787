"""Streams whose drift decides which model scores them next, and rows that state and watermark put in order."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import frames
from driftline.sources import store
from driftline.streaming.jobs import SCHEMA, continued, last_rows

HOUR = 3_600_000_000


def replay(events: DataFrame, part: Column, folder: str, run) -> None:
    """Writes events (the columns of the events table) part after part, in the order of `part`, and calls run(folder, last)
    after each, as a scheduled job would that takes what has come since. A part is as many files as its rows need. Only the
    numbers of the parts are on the driver, one for each call."""
    parts = [r[0] for r in events.select(part.alias("p")).distinct().orderBy("p").collect()]
    for i, p in enumerate(parts):
        events.where(part == p).write.mode("append").parquet(folder)
        run(folder, i == len(parts) - 1)


@dataclass(frozen=True)
class Settings:
    """training: rows of the training set. Drift is a mean over `shift` deviations from the version's, or a deviation
    `ratio` times larger or smaller. A new version starts from its parent and goes `pull` of the way to the training set."""

    training: int = 100
    shift: float = 1.0
    ratio: float = 2.0
    pull: float = 0.5


#: How versions descend: each from the one in force (retrained in place), or all from the first (forked from it).
STRATEGIES = ("chain", "fork")
FORCE = "series_id string, strategy string, version int, parent int, from_t long, mu double, root_mu double, ref_mu double, ref_sd double, born boolean"
SCORED = "series_id string, t long, strategy string, version int, nc double"


class VersionLoop:
    """A stream scored by versions of a level forecaster, for each strategy side by side: rows of a trigger are scored by
    the versions that the triggers before have left in force, then the last rows of each series are held against what its
    version was made from, and a drift adds a version to the tree, with its parent and the first row that it will score.

    Each trigger is a table: scores, the last rows of each series and the versions in force, with those just born, are
    written under the trigger's number, so a trigger that runs again replaces its own. What a trigger reads of the past is the last
    `training` rows of a series and a row a series and strategy. Rows without a value or a time play no part.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        self.spark, self.settings, self.at = spark, settings, f"{folder}/{uuid.uuid4().hex}"
        spark.createDataFrame([], SCORED).write.parquet(f"{self.at}/scores/trigger=-1")
        spark.createDataFrame([], FORCE).write.parquet(f"{self.at}/force/trigger=-1")

    def run(self, folder: str, last: bool = True) -> None:
        """One trigger over the event files that have come to folder since the last one."""
        stream = self.spark.readStream.schema(SCHEMA).parquet(folder)
        stream.writeStream.option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).foreachBatch(self.trigger).start().awaitTermination()

    def trigger(self, df: DataFrame, number: int) -> None:
        n, session = self.settings.training, df.sparkSession
        tail = session.read.schema("series_id string, t long, value double").parquet(f"{self.at}/tail/{number - 1}") if number else session.createDataFrame([], "series_id string, t long, value double")
        force = session.read.schema(FORCE).parquet(f"{self.at}/force/trigger={number - 1}")
        save = lambda d, name: d.write.mode("overwrite").parquet(f"{self.at}/{name}")
        e = df.where("value is not null and ts is not null").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
        new = store.written(continued(e, tail))
        save(new.join(force, "series_id").select("series_id", "t", "strategy", "version", F.abs(F.col("value") - F.col("mu")).alias("nc")), f"scores/trigger={number}")
        save(last_rows(new.withColumn("_new", F.lit(True)).unionByName(tail.withColumn("_new", F.lit(False))), n), f"tail/{number}")

        sets = session.read.schema("series_id string, t long, value double, _new boolean").parquet(f"{self.at}/tail/{number}").groupBy("series_id").agg(
            F.count("*").alias("n"), F.bool_or("_new").alias("_new"), (F.max("t") + 1).alias("to_t"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.stddev_pop("value").alias("sp"))
        stats = sets.where(F.col("_new") & (F.col("n") == n)).drop("_new", "n")
        both = F.explode(F.array(*[F.lit(x) for x in STRATEGIES])).alias("strategy")
        names = [c.split()[0] for c in FORCE.split(", ")]
        m = F.col("m")
        roots = stats.join(force, "series_id", "left_anti").select("series_id", both, F.lit(0).alias("version"), F.lit(None).cast("int").alias("parent"), F.col("to_t").alias("from_t"), m.alias("mu"), m.alias("root_mu"), m.alias("ref_mu"), F.col("sp").alias("ref_sd"), F.lit(True).alias("born"))
        drift = (F.abs(m - F.col("ref_mu")) > F.lit(self.settings.shift) * F.col("ref_sd")) | (F.col("s") < F.col("ref_sd") / self.settings.ratio) | (F.col("s") > F.col("ref_sd") * self.settings.ratio)
        chain = F.col("strategy") == "chain"
        start = F.when(chain, F.col("mu")).otherwise(F.col("root_mu"))
        born = {"version": F.col("version") + 1, "parent": F.when(chain, F.col("version")).otherwise(0), "from_t": F.col("to_t"), "mu": start + self.settings.pull * (m - start), "ref_mu": m, "ref_sd": F.col("sp")}
        next_ = force.join(stats, "series_id", "left").withColumn("_drift", F.coalesce(drift, F.lit(False)))
        next_ = next_.select(*[F.when(F.col("_drift"), born[c]).otherwise(F.col(c)).alias(c) if c in born else F.col("_drift").alias(c) if c == "born" else F.col(c) for c in names])
        save(next_.unionByName(roots), f"force/trigger={number}")

    def versions(self) -> DataFrame:
        """series_id, strategy, version, parent (null for a first one), from_t, mu."""
        born = self.spark.read.schema(f"{FORCE}, trigger long").parquet(f"{self.at}/force").where("born")
        return born.select("series_id", "strategy", "version", "parent", "from_t", "mu")

    def scores(self) -> DataFrame:
        return self.spark.read.schema(f"{SCORED}, trigger long").parquet(f"{self.at}/scores").drop("trigger")


#: Rows that a recursive query may give before Spark stops it, unless the session says otherwise.
RECURSED = 1_000_000


def lineage(versions: DataFrame) -> DataFrame:
    """versions with depth (0 for a first version) and lineage (the versions from the first one to this), by a recursive
    query that goes one generation a step; as many steps as the deepest tree has."""
    spark = versions.sparkSession
    deepest, n = versions.agg(F.coalesce(F.max("version"), F.lit(0)), F.count("*")).first()
    if n > RECURSED:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(f"""
WITH RECURSIVE line MAX RECURSION LEVEL {deepest + 2} AS (
  SELECT series_id, strategy, version, 0 AS depth, CAST(version AS STRING) AS lineage FROM {{v}} WHERE parent IS NULL
  UNION ALL
  SELECT v.series_id, v.strategy, v.version, line.depth + 1, concat(line.lineage, '>', v.version) FROM line JOIN {{v}} v ON v.series_id = line.series_id AND v.strategy = line.strategy AND v.parent = line.version)
SELECT v.*, line.depth, line.lineage FROM {{v}} v JOIN line USING (series_id, strategy, version)""", v=versions)  # fmt: skip


def tree_report(loop: VersionLoop) -> DataFrame:
    """Every version with its lineage, the rows that it scored (n) and their nonconformity in all (total_nc)."""
    sums = loop.scores().groupBy("series_id", "strategy", "version").agg(F.count("*").alias("n"), F.sum("nc").alias("total_nc"))
    return lineage(store.written(loop.versions())).join(sums, ["series_id", "strategy", "version"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def version_tree_sql(part: str, settings: Settings) -> str:
    """The same from whole tables: e (series_id, t, value and the part of its trigger)."""
    n = settings.training
    return f"""w AS (SELECT *, {part} AS g, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s, stddev_pop(value) OVER f AS sp FROM e WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS {n - 1} PRECEDING)),
st AS (SELECT series_id, t + 1 AS from_t, m, s, sp, row_number() OVER (PARTITION BY series_id ORDER BY g) AS k FROM
  (SELECT *, row_number() OVER (PARTITION BY series_id, g ORDER BY t DESC) AS o FROM w) WHERE o = 1 AND t >= {n - 1}),
r AS (SELECT series_id, strategy, k, 0 AS version, -1 AS parent, from_t, m AS mu, m AS root_mu, m AS ref_mu, sp AS ref_sd, true AS born FROM st, (SELECT unnest(['chain', 'fork']) AS strategy) WHERE k = 1
  UNION ALL SELECT series_id, strategy, k, CASE WHEN drift THEN version + 1 ELSE version END, CASE WHEN NOT drift THEN parent WHEN strategy = 'chain' THEN version ELSE 0 END, from_t,
    CASE WHEN NOT drift THEN mu WHEN strategy = 'chain' THEN mu + {settings.pull}::DOUBLE * (m - mu) ELSE root_mu + {settings.pull}::DOUBLE * (m - root_mu) END, root_mu, CASE WHEN drift THEN m ELSE ref_mu END, CASE WHEN drift THEN sp ELSE ref_sd END, drift
  FROM (SELECT r.series_id, r.strategy, st.k, r.version, r.parent, st.from_t, r.mu, r.root_mu, r.ref_mu, r.ref_sd, st.m, st.sp,
      abs(st.m - r.ref_mu) > {settings.shift}::DOUBLE * r.ref_sd OR st.s < r.ref_sd / {settings.ratio} OR st.s > r.ref_sd * {settings.ratio} AS drift FROM r JOIN st ON st.series_id = r.series_id AND st.k = r.k + 1)),
v AS (SELECT * FROM r WHERE born),
line AS (SELECT series_id, strategy, version, 0 AS depth, version::VARCHAR AS lineage FROM v WHERE parent = -1
  UNION ALL SELECT v.series_id, v.strategy, v.version, depth + 1, lineage || '>' || v.version FROM line JOIN v ON v.series_id = line.series_id AND v.strategy = line.strategy AND v.parent = line.version),
u AS (SELECT *, lead(from_t) OVER (PARTITION BY series_id, strategy ORDER BY version) AS until FROM v)
SELECT u.series_id, u.strategy, u.version, u.parent, u.from_t, line.depth, line.lineage, round(u.mu, 6) AS mu, count(e.t) AS n, round(sum(abs(e.value - u.mu)), 4) AS total_nc
FROM u JOIN line USING (series_id, strategy, version) LEFT JOIN e ON e.series_id = u.series_id AND e.t >= u.from_t AND (until IS NULL OR e.t < until) GROUP BY ALL"""


#: Where streams within `rocks` keep their state, and that a trigger saves what it has changed, not all that there is.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB; the session's own choice comes back after."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_order(events: DataFrame, late: str, width: int = HOUR) -> DataFrame:
    """The events of a stream (event_type, ts, event_id, value), each stretch of `width` microseconds of a series given out
    once the watermark has passed it, so that no later trigger brings rows before it. Rows may be `late`; rows that are
    later go. Rows without a type or a time play no part.

    The state is a list of rows for each series and stretch, which Spark keeps, gives out and clears by itself, so no
    trigger starts Python; a hot series is many keys. Many rows need the RocksDB state store.
    """
    e = events.where("event_type is not null and ts is not null").withWatermark("ts", late)
    row = F.struct("ts", F.coalesce("event_id", F.lit(0)).alias("event_id"), "value")
    kept = e.groupBy("event_type", F.window("ts", f"{width} microseconds").alias("stretch")).agg(F.collect_list(row).alias("rows"))
    return kept.select("event_type", F.explode("rows").alias("row")).select("event_type", "row.*")


def end_of_stream(events: DataFrame, late_days: int) -> DataFrame:
    """A row without a type so late that the watermark passes all others."""
    return events.agg(F.max("ts").alias("ts")).select(F.lit(0).cast("long").alias("event_id"), (F.col("ts") + F.make_interval(days=F.lit(late_days + 3))).alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
