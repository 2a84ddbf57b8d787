"""Line deduplication over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import SPACES, ascii_lower, let, split_join, table


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_docs: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each line dropped whose normalised form stands in more than max_docs documents, except in the
    document with the smallest id; and the columns n_lines and n_dropped (both long).

    Lines are exploded, normalised and hashed (128 bits); documents are counted by hash after a partial aggregation, so
    a line in a third of all documents is one row a task, and Spark can split the join that brings the counts back. The
    texts move once, to meet the positions that they lose.
    A null text is an empty line. Documents with a null id keep their lines and don't count. Rows that share an id
    count as one document. Other columns stay; n_lines and n_dropped replace columns of that name.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(body)
    lines = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), mark.alias("t"), F.posexplode(F.split(body, "\n")).alias("at", "line"))
    lines = lines.where(F.length(F.btrim("line", F.lit(SPACES))) >= min_chars).select("d", "t", "at", line_key(F.col("line")).alias("k"))
    lines = lines.select("d", "t", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    if max_docs == 1:  # the smallest and the largest id tell whether there are two
        common = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    else:
        common = lines.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.min("d").alias("first"), F.count("*").alias("n")).where(F.col("n") > max_docs).drop("n")
    lost = split_join(lines, common, ["h1", "h2"]).where("d > first").groupBy("d", "t").agg(F.collect_set("at").alias("lost"))

    def kept(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce(F.col("lost"), F.array().cast("array<int>")))
        return F.struct(F.size(parts).cast("long").alias("n"), F.transform(left, lambda i: F.get(parts, i)).alias("lines"))

    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("d"), mark.alias("t"), body.alias("body"))
    rows = rows.join(lost.hint("shuffle_hash"), ["d", "t"], "left").select("row", let(F.split("body", "\n"), kept).alias("x"))
    rows = rows.select("row.*", F.col("x").alias("_kept"))
    out = {text: F.array_join("_kept.lines", "\n"), "n_lines": F.col("_kept.n"), "n_dropped": F.col("_kept.n") - F.size("_kept.lines")}
    return rows.select(*[c for c in docs.columns if c not in out or c == text], "_kept").withColumns(out).drop("_kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (first IS NOT NULL AND doc_id <> first)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
