"""SimHash document fingerprints with permuted block tables."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import hex16, pieces_of, shingles, stable, table, vote_sums, voted


def term_fingerprints(texts: DataFrame, keys: list[str], text: str = "text", k: int = 5) -> DataFrame:
    """keys and fp, one row for each distinct value of keys: a term is a run of k words and weighs as many votes as it
    has characters, so runs of long, rare words count more; a bit is set by more than half of the votes. Each term votes
    as often as it occurs. No word: zero. Columns beside keys and text play no part."""
    each = texts.select(*keys, F.explode_outer(shingles(F.col(text), k)).alias("s"))
    votes = each.select(*keys, F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h"), F.length("s").cast("long").alias("w"))
    sums = votes.groupBy(*keys).agg(F.sum("w").alias("votes"), *vote_sums(F.col("h"), F.col("w")))
    return sums.select(*keys, F.coalesce(voted(F.col("votes")), F.lit(0).cast("long")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


@dataclass(frozen=True)
class Tables:
    """Permuted block tables: the 64 bits in blocks, and a table for each choice of blocks - radius of them, keyed by
    their bits. Two fingerprints within the radius agree in at least that many blocks, so they meet in some table."""

    radius: int = 3
    blocks: int = 5

    def masks(self) -> list[int]:
        cuts = [round(i * 64 / self.blocks) for i in range(self.blocks + 1)]
        block = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]
        return [sum(block[i] for i in c) for c in combinations(range(self.blocks), self.blocks - self.radius)]

    def entries(self, fps: DataFrame) -> DataFrame:
        """(fp, table, key)"""
        cut = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for i, m in enumerate(self.masks())])
        return fps.select("fp", F.explode(cut).alias("x")).select("fp", "x.table", "x.key")

    def turns(self, i: int, most: int) -> list[int]:
        """Masks of at most so many bits outside the key of table i."""
        rest = [b for b in range(64) if not self.masks()[i] >> b & 1]
        return [_signed(sum(1 << b for b in c)) for n in range(most + 1) for c in combinations(rest, n)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _long(m: int) -> Column:
    return F.lit(_signed(m)).cast("long")


def tables_for(n: int, radius: int = 3) -> Tables:
    """More blocks for more fingerprints: longer keys, so that few fingerprints share one by chance."""
    return Tables(radius, radius + (2 if n <= 1 << 25 else 3))


def near_pairs(fps: DataFrame, tables: Tables = Tables()) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (fp long, no nulls) within the radius, each once; none for an
    empty table. A pair is kept only in the first table where it agrees, and verified by its whole distance. The rows
    are as many as pairs within the radius, so this is for searches in which those are few; see nearest_least."""
    each = tables.entries(fps)
    left, right = each.withColumnRenamed("fp", "a"), each.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.array(*[differ.bitwiseAND(_long(m)) == 0 for m in tables.masks()]), True) - 1
    return left.join(right, ["table", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= tables.radius) & (first == F.col("table"))).select("a", "b")


def nearest_least(fps: DataFrame, tables: Tables, crowd: int = 64) -> DataFrame:
    """(fp, least): for distinct fingerprints (fp long), the smallest within the radius, for those that have a smaller
    one there. None is dropped or missed, however many share a key.

    A key that only one fingerprint has is left out before the join. Under a key with more than `crowd` of them, pairs
    would grow with the square of their number: there each writes down the patterns within a bits and within b bits of it
    outside the key, a + b being the radius. Any two within the radius share a pattern that is within a of one and
    within b of the other, and any two that share such a pattern are within it; so the least on the other side, one row
    a pattern, is all that each has to read.
    """
    each = tables.entries(fps).repartition("table", "key")
    counts = stable(each.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"))
    few = each.join(counts.where(F.col("n") <= crowd).drop("n").hint("merge"), ["table", "key"])
    other = few.select(F.col("table").alias("_table"), F.col("key").alias("_key"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= tables.radius
    met = few.join(other, (F.col("table") == F.col("_table")) & (F.col("key") == F.col("_key")) & (F.col("fp") > F.col("b")) & near).select("fp", F.col("b").alias("least"))
    inner = tables.radius // 2
    outer = tables.radius - inner
    many = each.join(counts.where(F.col("n") > crowd).drop("n").hint("merge"), ["table", "key"])

    def turned(most: int) -> Column:
        pick = F.coalesce(*[F.when(F.col("table") == i, F.lit(tables.turns(i, most)).cast("array<bigint>")) for i in range(len(tables.masks()))])
        return F.explode(pick)

    # the key's own bits stand in the pattern, so table and pattern name both
    wide = many.select("fp", "table", turned(outer).alias("m")).select("fp", "table", F.col("fp").bitwiseXOR(F.col("m")).alias("p"), (F.bit_count("m") <= inner).alias("close"))
    least = wide.groupBy("table", "p").agg(F.min("fp").alias("far_least"), F.min(F.when(F.col("close"), F.col("fp"))).alias("close_least"))
    said = wide.join(least, ["table", "p"]).select("fp", F.least(F.col("close_least"), F.when(F.col("close"), F.col("far_least"))).alias("least"))
    return met.unionByName(said).where("least < fp").groupBy("fp").agg(F.min("least").alias("least"))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_each: int = 500_000) -> DataFrame:
    """(d, t, n, next_d, next_t, prev_d, prev_t, prev_n): for each distinct id and text hash its length in characters
    and the neighbours in ascending (id, hash), null ids first; the last is followed by the first.

    Ids are dealt out by range, about rows_each to each, and ordered within each range; the ends of the ranges, one row
    each, are ordered by themselves. Only ids and lengths are moved. No documents give no rows; a single one is its own
    neighbour. Extra columns play no part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(F.col(key).alias("d"), F.xxhash64(body).alias("t"), F.length(body).cast("long").alias("n")).groupBy("d", "t").agg(F.first("n").alias("n"))
    ids = stable(ids)
    pieces = max(8, pieces_of(ids.count(), rows_each))
    ids = stable(ids.repartitionByRange(pieces, "d", "t").withColumn("part", F.spark_partition_id()))
    me = F.struct("d", "t", "n")
    within = Window.partitionBy("part").orderBy("d", "t")
    ids = ids.select("d", "t", "n", "part", F.lead(me).over(within).alias("next"), F.lag(me).over(within).alias("prev"))
    ends = ids.groupBy("part").agg(F.min(me).alias("lo"), F.max(me).alias("hi"))
    # one row a range; structs of nulls sort first, as ids do
    over = Window.orderBy("part")
    every = Window.partitionBy(F.lit(0))
    ends = ends.select("part", F.coalesce(F.lead("lo").over(over), F.min("lo").over(every)).alias("after"), F.coalesce(F.lag("hi").over(over), F.max("hi").over(every)).alias("ahead"))
    out = ids.join(F.broadcast(ends), "part").select("d", "t", "n", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "ahead").alias("prev"))
    return out.select("d", "t", "n", F.col("next.d").alias("next_d"), F.col("next.t").alias("next_t"), F.col("prev.d").alias("prev_d"), F.col("prev.t").alias("prev_t"), F.col("prev.n").alias("prev_n"))


def with_edits(docs: DataFrame, order: DataFrame, key: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """(d, t, n, next_d, next_t, text, edited): edited has its last n // part characters replaced by the first as many
    of the next document. A null text is an empty one, a null id stands before all others, rows stay as often as they
    are there; extra columns play no part."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(body).alias("t"), body.alias("text"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"d": "_d", "t": "_t"})
        return left.join(r, left["d"].eqNullSafe(r["_d"]) & (left["t"] == r["_t"])).drop("_d", "_t")

    heads = meet(rows, order.select("d", "t", "prev_d", "prev_t", F.floor(F.col("prev_n") / part).cast("int").alias("need")))
    heads = heads.select(F.col("prev_d").alias("d"), F.col("prev_t").alias("t"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head")).dropDuplicates(["d", "t"])
    both = meet(meet(rows, order.select("d", "t", "n", "next_d", "next_t")), heads)
    stay = (F.col("n") - F.floor(F.col("n") / part)).cast("int")
    return both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), stay), "head")).drop("head")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share an id and a text have the same result, whose next document is the next other one. near_least is
    the smallest fingerprint of any document within 3 bits of this one's, found through the block tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = neighbours(docs)
    rows = with_edits(docs, order)
    # a digest moves as bytes
    digest = F.unhex(F.sha2("edited", 256)).alias("sha")
    rows = rows.select("d", "t", "n", "next_d", "next_t", digest, F.explode(F.array(F.struct(F.lit(0).alias("is_edit"), F.col("text").alias("body")), F.struct(F.lit(1).alias("is_edit"), F.col("edited").alias("body")))).alias("x"))
    keys = ["d", "t", "n", "next_d", "next_t", "sha", "is_edit"]
    prints = term_fingerprints(rows.select(*keys[:-1], "x.is_edit", "x.body"), keys, "body")
    both = prints.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("is_edit") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("is_edit") == 1, F.col("fp"))).alias("edited_fp"))
    both = stable(both)
    after = both.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("fp").alias("next_fp"))
    out = both.join(after, both["next_d"].eqNullSafe(after["_d"]) & (both["next_t"] == after["_t"]))
    times = docs.groupBy(F.col("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t")).agg(F.count("*").alias("copies")).where("copies > 1")
    out = out.drop("_d", "_t").join(times, out["d"].eqNullSafe(times["_d"]) & (out["t"] == times["_t"]), "left")
    fps = stable(both.select("fp").distinct())
    near = nearest_least(fps, tables_for(fps.count())).withColumnRenamed("fp", "_fp")
    out = out.join(stable(near), F.col("fp") == F.col("_fp"), "left")
    out = out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), hex16(F.coalesce("least", "fp")).alias("near_least"), F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)).cast("long"))).alias("copy"))
    return out.drop("copy")
