"""Structured Streaming forms: event-time windows, and scores with state by series."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import frames
from driftline.sources import series as src
from driftline.sources import store

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, with an event time that watermarks take."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and mean value by type and window; rows later than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


SCORES, TAIL = "series_id string, t long, score double", "series_id string, t long, value double"


def continued(e: DataFrame, tail: DataFrame) -> DataFrame:
    """(series_id, t, value) of a trigger's rows (series_id, ts, event_id, value), numbered on from the last rows of each
    series, which tail has."""
    new = src.numbered(e, "series_id", ["ts", "event_id"], F.date_trunc("day", "ts")).select("series_id", "t", "value")
    seen = tail.groupBy("series_id").agg((F.max("t") + 1).alias("_seen"))
    return new.join(seen, "series_id", "left").withColumn("t", F.col("t") + F.coalesce("_seen", F.lit(0))).drop("_seen")


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    return frames.last_windows(rows, n)


def rolling_scores(events: DataFrame, folder: str, length: int = 50, run: Callable[[Callable], None] | None = None) -> DataFrame:
    """By type, the mean of the last `length` absolute changes of the value, with the rows of a trigger in time order.

    Runs the stream over what there is and returns all scores. Each trigger is scored as a table, in chunks of rows, so
    a trigger with a long series is many tasks. State: the last `length` rows of each series, a small table for each
    trigger, under the trigger's number, as are its scores; a trigger that runs again replaces both. Rows that come in a
    later trigger count as later. The folder must be one that all executors share. run(start) may call start() more than
    once, as files come.
    """
    spark, at = events.sparkSession, f"{folder}/{uuid.uuid4().hex}"

    def trigger(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        # the empty table stands before the first trigger
        tail = session.read.schema(TAIL).parquet(f"{at}/tail/{number - 1}") if number else session.createDataFrame([], TAIL)
        # once: each reading of a trigger goes through the stream's state again
        new = store.written(df.select(F.col("event_type").alias("series_id"), "ts", "event_id", "value"))
        if number and new.isEmpty():  # the watermark has passed nothing; the next trigger reads the same tail
            tail.write.mode("overwrite").parquet(f"{at}/tail/{number}")
            return
        new = store.written(continued(new, tail))
        both = new.withColumn("_new", F.lit(True)).unionByName(tail.withColumn("_new", F.lit(False)))
        changes = frames.nonconformity(both)
        scored = frames.rolling(changes, length - 1, {"score": lambda w: F.avg("nc").over(w.rowsBetween(-(length - 1), 0))})
        scored.where((F.col("t") >= length - 1) & F.col("_new")).select("series_id", "t", "score").write.mode("overwrite").parquet(f"{at}/scores/trigger={number}")
        last_rows(both, length).select("series_id", "t", "value").write.mode("overwrite").parquet(f"{at}/tail/{number}")

    spark.createDataFrame([], SCORES).write.parquet(f"{at}/scores/trigger=-1")
    start = lambda: events.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(trigger).start().awaitTermination()
    start() if run is None else run(start)
    return spark.read.schema(f"{SCORES}, trigger long").parquet(f"{at}/scores").drop("trigger")


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what there is and returns all it has put out; the folder must be one that all executors
    share."""
    spark, at = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:  # each trigger replaces the result so far
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
