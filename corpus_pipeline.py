"""The corpus pipeline: quality classifier, line deduplication, near-duplicates, mixing, packing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import line_dedup, mixing, packing, quality, simhash_dedup
from driftline.llm.common import shared_folder, slices, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.7 or more, each as often as it is there; a null or empty text
    scores the share of label 1. Without documents or labels: none, or what that share decides."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.score_texts(docs, model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller doc_id has; a null text becomes an empty one, a null id keeps its
    lines, rows that share an id count as one document."""
    return _documents(line_dedup.dedup_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8) the document with the smallest doc_id."""
    return simhash_dedup.keep_one(docs, simhash_dedup.similar_groups(docs)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over its source in which the mix takes words from a document: the text whole if all its words
    are taken, else the words taken, one space between them. Documents from which the mix takes nothing go."""
    m = mixing.mix(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = []
            for text, size, spans in zip(*[part.column(c).to_pylist() for c in ("text", "size", "spans")], strict=True):
                if sum(s["hi"] - s["lo"] for s in spans) < size:
                    w = text.encode().split()
                    text = b" ".join(x for s in spans for x in w[s["lo"] : s["hi"]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("lang"), part.column("source")], ["doc_id", "text", "lang", "source"])

    parts = m.parts().join(m.sizes.select("row", F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "size"), "row")
    # rows that share an id and a text are one document here, which stands in the mix as often as its rows
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(parts.select("_d", "_t", "size", "spans", "row", "epoch"), rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["_hash"] == F.col("_t")))
    rows = rows.dropDuplicates(["row", "epoch"]) if m.repeated else rows
    taken = rows.select("doc_id", "text", "lang", "source", "size", "spans").mapInArrow(cut, "doc_id long, text string, lang string, source string")
    return _documents(taken)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all rows, each placed in a sequence; null and repeated ids are packed like any other."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the second can be said in SQL; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
