"""Sinks and catalogues of runs: scores by approach, results as JSON, model versions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Training-set updates, drift tests and scores that make up the approaches.
UPDATES, DRIFTS, SCORES = ("sw", "ures"), ("mu_sig", "ks"), ("avg", "al", "cl")


def approaches(spark: SparkSession) -> DataFrame:
    """(strategy, score): each shared training set with each score, and score-aware ones with the score they follow."""
    rows = [(f"{u}_{d}", s) for u in UPDATES for d in DRIFTS for s in SCORES] + [(f"ares_{s}_{d}", s) for s in ("al", "cl") for d in DRIFTS]
    return spark.createDataFrame(rows, "strategy string, score string")


def write_scores(scores: DataFrame, path: str, model: str, strategy: str, score: str, run: str, fmt: str = "csv") -> None:
    """Appends (series_id, t, ..) under partitions of series, model, strategy, score and run."""
    out = scores.withColumns({"model": F.lit(model), "strategy": F.lit(strategy), "score_kind": F.lit(score), "run": F.lit(run)})
    writer = out.write.mode("append").partitionBy("series_id", "model", "strategy", "score_kind", "run")
    (writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path))


#: Folders of confidence levels and of p-values, beside those of scores.
LEVELS, P_VALUES = "confidence_levels", "pvalues"


def read_scores(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None, keep: Column | None = None) -> DataFrame:
    """All runs; partitions are columns. Of several runs of an approach the first counts. A schema spares the reading that
    finds the types of a CSV file. keep: a condition on series, model, strategy, score and run; other folders are not read."""
    reader = spark.read.format(fmt).options(**({"header": "true", "inferSchema": str(schema is None)} if fmt == "csv" else {}))
    df = (reader.schema(f"{schema}, series_id string, model string, strategy string, score_kind string, run string") if schema else reader).load(path)
    df = df if keep is None else df.where(keep)
    keys = ["series_id", "model", "strategy", "score_kind"]
    first = df.groupBy(*keys).agg(F.min(F.col("run").cast("string")).alias("_run"))
    return df.join(first, keys).where(F.col("run").cast("string") == F.col("_run")).drop("_run")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_models(models: DataFrame, path: str) -> None:
    """models: series_id, approach, version, from_t, weights (binary)."""
    models.write.mode("append").partitionBy("approach").parquet(path)


def weight_folders(names: DataFrame, path: str) -> DataFrame:
    """names (series_id, model, strategy, score_kind, run) with folder, where an approach's weights are written; a null score
    stands for each score that follows the strategy."""
    each = names.join(approaches(names.sparkSession), "strategy").where(F.col("score_kind").isNull() | (F.col("score_kind") == F.col("score")))
    folder = F.concat_ws("/", F.lit(path), "series_id", F.concat_ws("-", "model", "strategy", "score"), "run")
    return each.select("series_id", "model", "strategy", F.col("score").alias("score_kind"), "run", folder.alias("folder"))


def write_overlay(overlay: DataFrame, path: str, first: int, last: int) -> None:
    """The replaced rows of an artificial anomaly, in a folder that names its first and last row."""
    overlay.write.mode("overwrite").option("header", "true").csv(f"{path}/anomaly_{first}-{last}")


def read_overlays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All overlays under path with the interval that each folder's name gives."""
    df = spark.read.schema(schema).option("header", "true").csv(f"{path}/anomaly_*")
    at = lambda i: F.regexp_extract(F.input_file_name(), r"anomaly_(\d+)-(\d+)", i).cast("long")
    return df.withColumns({"first": at(1), "last": at(2)})


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, step, content) of weight files called ..-stepN.., for models that were written as files."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"step(\d+)", 1).cast("long").alias("step"), "content")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where none is set, a temporary one on one machine, an error on a
    cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="driftline-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder once for all that read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fan_out(nonconformity: DataFrame, names: DataFrame) -> DataFrame:
    """A model's nonconformity for every approach that follows it: names has model, strategy and score."""
    return nonconformity.join(names.withColumnRenamed("score", "score_kind"), "model")


def approach_parts(name: Column) -> list[Column]:
    """model, strategy and score of an approach's name, which joins them by hyphens."""
    parts = F.split(name, "-")
    return [parts[i].alias(k) for i, k in enumerate(("model", "strategy", "score_kind"))]
