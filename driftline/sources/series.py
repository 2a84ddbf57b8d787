"""Series tables: series_id, t (0, 1, ..), channels and a label; from files and from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: list[str], bucket: Column, name: str = "t") -> DataFrame:
    """df with t (or `name`), the position from 0 in each series by `order`. bucket must rise with the order: rows are ranked in
    buckets, and counts of buckets added up, so a long series is not sorted in one task."""
    df = df.withColumn("_b", bucket)
    ahead = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    first = counts.select(key, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    return df.withColumn("_rank", rank).join(first, [key, "_b"]).withColumn(name, F.col("_first") + F.col("_rank") - 1).drop("_b", "_rank", "_first")


def read_series(spark: SparkSession, path: str, time_column: str, label_column: str, channels: list[str] | None = None, fmt: str = "csv", schema: str | None = None, bucket: Column | None = None, **options) -> DataFrame:
    """(series_id, t, values, is_anomaly) from files whose first column is a position and last a label; series_id is the
    file's name. channels default to all other columns, in order. Without a schema a CSV file is read once more to find
    its types. bucket, which must rise with the position, parts long files for their numbering; by default 8,192 units of
    a number, or a day; other positions are not parted."""
    reader = spark.read.format(fmt).options(**({"header": "true", "inferSchema": str(schema is None)} if fmt == "csv" else {}), **options)
    df = (reader.schema(schema) if schema else reader).load(path)
    if bucket is None:
        kind = df.schema[time_column].dataType
        at = F.col(time_column)
        bucket = F.floor(at / 8192) if isinstance(kind, T.NumericType) else F.date_trunc("day", at) if isinstance(kind, T.DatetimeType | T.TimestampNTZType) else F.lit(0)
    channels = channels or [c for c in df.columns if c not in (time_column, label_column)]
    values = F.array(*[F.col(c).cast("double") for c in channels])
    df = df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("series_id"), F.col(time_column).alias("_at"), bucket.alias("_part"), values.alias("values"), F.col(label_column).cast("int").alias("is_anomaly"))
    return numbered(df, "series_id", ["_at"], F.col("_part")).select("series_id", F.col("t").cast("long").alias("t"), "values", "is_anomaly")


def train_or_prefix(series: DataFrame, train: DataFrame | None, rows: int) -> DataFrame:
    """The training part: its own file if there is one, else the first rows of each series."""
    return series.where(F.col("t") < rows) if train is None else train


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (event type), t, value, is_anomaly (value > 150)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    e = numbered(e, "series_id", ["ts", "event_id"], F.date_trunc("day", F.col("ts").cast("timestamp")))
    return e.select("series_id", "t", "value", (F.col("value") > 150).cast("int").alias("is_anomaly"))


EVENTS_SQL = """e AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t,
  value, (value > 150)::INTEGER AS is_anomaly FROM events)"""


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of all events, labelled by the type error."""
    e = table(spark, sf_dir, "events").select(F.lit("all").alias("series_id"), "ts", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("is_anomaly"))
    e = numbered(e, "series_id", ["ts", "event_id"], F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.select("series_id", "t", "value", "is_anomaly")


ALL_EVENTS_SQL = """e AS (SELECT 'all' AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, value,
  (event_type = 'error')::INTEGER AS is_anomaly FROM events)"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of four channels: day, t, and by ship date the sums of quantity and price and the means of discount
    and tax, rounded."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.sum("l_quantity"), 2).alias("c0"), F.round(F.sum("l_extendedprice"), 2).alias("c1"),
        F.round(F.avg("l_discount") + F.lit(0.0), 6).alias("c2"), F.round(F.avg("l_tax") + F.lit(0.0), 6).alias("c3"))
    d = numbered(d.withColumn("series_id", F.lit("lineitem")), "series_id", ["day"], F.year("day"))
    return d.select("series_id", "t", "day", F.array("c0", "c1", "c2", "c3").alias("values"))


SHIPMENTS_SQL = """d AS (SELECT l_shipdate::DATE AS day, round(sum(l_quantity), 2) AS c0, round(sum(l_extendedprice), 2) AS c1,
  round(avg(l_discount) + 0.0, 6) AS c2, round(avg(l_tax) + 0.0, 6) AS c3, row_number() OVER (ORDER BY l_shipdate::DATE) - 1 AS t
  FROM lineitem GROUP BY l_shipdate::DATE)"""


def to_long(series: DataFrame) -> DataFrame:
    """A row for each channel."""
    return series.select("series_id", "t", F.posexplode("values").alias("ch", "x"))
