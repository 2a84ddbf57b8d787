"""Shared column expressions and small Spark helpers of the corpus operators."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else unchanged; texts of single bytes only take Spark's fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE_RUN), "")


def id_crc(c: Column) -> Column:
    """crc32 of an id as text; 0 for a null id."""
    return F.coalesce(F.crc32(c.cast("string")), F.lit(0).cast("long"))


def stable(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there by all that follows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a new temporary one on one machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="driftline-"))
    return sc.getCheckpointDir()


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, a table with a row a key that was counted from left. It is written first: behind a join
    whose both sides are plain shuffles Spark can deal the rows of a hot key of left out to several tasks."""
    return left.join(stable(right), on, how)


def hot_keys(rows: DataFrame, on: list[str], share: int = 1000, one_in: int = 64) -> DataFrame:
    """The keys that hold more than 1 / share of the rows sampled, one in `one_in` by a hash of all columns: fewer than
    `share` keys whatever the rows hold, so that they may be broadcast. Which they are decides only how rows are joined."""
    some = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(one_in)) == 0)
    counts = some.groupBy(on).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(some.agg(F.count("*").alias("all"))), F.col("n") * share > F.col("all")).select(on)


def pieces_of(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def shingles(text: Column, k: int) -> Column:
    """All runs of k words joined by a space, repeats included; the whole sequence if there are fewer, none if no word."""
    def runs(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(1), F.greatest(n - F.lit(k - 1), F.lit(1)))
        return F.when(n > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), runs)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of about so many bytes (or items) of a column: only a slice at a time becomes
    Python objects."""
    for batch in batches:
        x = batch.column(column)
        length = pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x)
        size = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(size):
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + most)) + 1
            yield batch.slice(at, to - at)
            at = to


#: One bit in the lower and one in the upper half of a 64-bit word: two counters share each sum.
_PAIR = (1 << 32) | 1


def vote_sums(h: Column, weight: Column) -> list[Column]:
    """32 sums that hold, for the bits j and j + 32 of h, the weight of the rows where the bit is set."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"v{j}") for j in range(32)]


def voted(total: Column, prefix: str = "v") -> Column:
    """The 64-bit fingerprint whose bits have more than half of the total weight."""
    out = F.lit(0).cast("long")
    for j in range(32):
        s = F.col(f"{prefix}{j}")
        low, high = s.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(s, 32)
        bit = lambda b: F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        out = out.bitwiseOR(F.when(low * 2 > total, bit(j)).otherwise(F.lit(0).cast("long")))
        out = out.bitwiseOR(F.when(high * 2 > total, bit(j + 32)).otherwise(F.lit(0).cast("long")))
    return out


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long): root is the smallest node it reaches.

    Large-star and small-star rounds in turn: each hangs neighbours on the smallest one known, so that trees of any
    shape become stars after a number of rounds near the logarithm of their size. A node with very many neighbours
    costs one aggregated row and a join that Spark can split; no neighbour list is gathered.
    """
    ends = lambda e: e.where(F.col("a") != F.col("b"))
    # every edge points from the larger to the smaller node
    e = stable(ends(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct())
    said = None
    for _ in range(rounds):
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("x")).select("x.a", "x.b")
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("k"), F.min("b")).alias("m"))
        # every larger neighbour of a node hangs on the smallest around it
        large = e.join(least, F.col("b") == F.col("k")).select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        # of a node's smaller neighbours all but the smallest hang on that one, and so does the node
        over = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        e = stable(large.join(least, F.col("a") == F.col("k")).select(over.alias("a"), F.col("m").alias("b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            break
        said = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, given pairs a[i], b[i] of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
