"""Resharding by minimum-cost flow."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import pieces_of, shared_folder, stable, table


def min_cost_flow(supply: list[int], room: list[int], cost) -> dict[tuple[int, int], int]:
    """Units sent from each source to each sink at the least total cost(i, j), every source emptied; {(i, j): units}.

    Successive shortest paths with potentials over the bipartite graph. Its size is that of the shard lists, never that
    of the data.
    """
    n, m = len(supply), len(room)
    if sum(supply) > sum(room):
        raise ValueError("the new capacities hold less than the old shards")
    flow: dict[tuple[int, int], int] = {}
    left, free, pot = list(supply), list(room), [0] * (n + m)
    while any(left):
        dist, before = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                nexts = [(n + j, cost(u, j)) for j in range(m)]
            else:
                nexts = [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, c in nexts:
                if (x := d + c + pot[u] - pot[v]) < dist[v]:
                    dist[v], before[v] = x, u
                    heapq.heappush(heap, (x, v))
        end = min((j for j in range(m) if free[j]), key=lambda j: dist[n + j] + pot[n + j])
        path, v = [], n + end
        while v >= 0:
            path.append(v)
            v = before[v]
        path.reverse()
        units = min(left[path[0]], free[end])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                units = min(units, flow[(b, a - n)])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + units
            else:
                flow[(b, a - n)] -= units
        left[path[0]] -= units
        free[end] -= units
        top = max(d for d in dist if d < float("inf"))
        pot = [p + min(d, top) for p, d in zip(pot, dist, strict=False)]
    return {k: v for k, v in flow.items() if v}


def transfers(sizes: dict[int, int], capacities: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each old shard, (new shard, bytes) with the bytes that stay first: the minimum-cost flow where bytes that
    stay cost nothing and bytes that move cost one each.

    Under such costs a flow is least when as much stays as each new shard holds, wherever the rest goes: one sweep over
    what is left of the old shards and of the room. Tests hold it against min_cost_flow.
    """
    if sum(sizes.values()) > sum(capacities):
        raise ValueError("the new capacities hold less than the old shards")
    stay = {i: min(n, capacities[i]) if 0 <= i < len(capacities) else 0 for i, n in sizes.items()}
    room = [c - stay.get(j, 0) for j, c in enumerate(capacities)]
    out, j = {}, 0
    for i in sorted(sizes):
        out[i] = [(i, stay[i])] if stay[i] else []
        left = sizes[i] - stay[i]
        while left:
            while not room[j]:
                j += 1
            units = min(left, room[j])
            out[i].append((j, units))
            left, room[j] = left - units, room[j] - units
    return out


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _keyed(docs: DataFrame, old_shard: Column, key: str, text: str) -> DataFrame:
    """docs with _old, _size, _crc and _at, a document's place in its old shard: large documents first, in steps of
    size, then by a hash. A row without an old shard counts to the shard -1, which no layout has, so it moves."""
    crc, size = F.crc32(F.coalesce(F.col(text), F.lit(""))), byte_size(F.col(text))
    rows = docs.withColumns({"_old": F.coalesce(old_shard.cast("int"), F.lit(-1)), "_size": size, "_crc": crc})
    bin_ = (-F.floor(F.log2(F.col("_size").cast("double")) * 4)).cast("int")
    return rows.withColumn("_at", F.struct(bin_.alias("bin"), F.xxhash64(key, "_crc").alias("h"), F.col(key).cast("long").alias("d"), F.col("_crc").alias("c")))


@dataclass
class Resharding:
    """Where documents go. cuts: for each old shard its pieces in order, each as the place of its first document and the
    new shard; at most as many as there are old and new shards together."""

    cuts: DataFrame
    old_shard: Column
    key: str
    text: str

    def place(self, docs: DataFrame) -> DataFrame:
        """docs with _old, _size, _crc and shard. The rule needs nothing but the row and the cuts. docs are the rows that
        the cuts were made from, each as often as it is there, a null id or text like any other; columns of these names are
        replaced, others stay. No rows give none."""
        rows = _keyed(docs, self.old_shard, self.key, self.text)
        pieces = F.broadcast(self.cuts.groupBy(F.col("old_shard").alias("_o")).agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("_pieces")))
        rows = rows.join(pieces, F.col("_old") == F.col("_o"))
        return rows.withColumn("shard", F.element_at(F.filter("_pieces", lambda c: c["first"] <= F.col("_at")), -1)["shard"]).drop("_at", "_o", "_pieces")


def reshard(docs: DataFrame, old_shard: Column, n_new: int, block_rows: int = 500, max_shards: int = 10_000, key: str = "doc_id", text: str = "text") -> Resharding:
    """How docs move from their old shards into n_new shards of equal bytes.

    The totals of shards, at most max_shards of them, reach the driver, and the flow says how many bytes of an old shard
    stay and where the rest goes. Each old shard is ordered by size, large documents first, and cut where the bytes
    before reach those amounts, so cuts fall among small documents and shards differ by a few of those. Bytes before a
    document are sums over blocks of about block_rows documents plus a sum within its block, so no task holds a shard;
    a piece's first document is all that comes back. A null text has no bytes; rows with a null or repeated id are
    placed like any other, rows that share an id and a text alike. No documents: no pieces. Extra columns play no part.
    """
    rows = stable(_keyed(docs.select(key, text, old_shard.cast("int").alias("_old_shard")), F.col("_old_shard"), key, text).select(F.col("_old").alias("old_shard"), F.col("_size").alias("size"), F.col("_at").alias("at")))
    counts = rows.groupBy("old_shard", F.col("at.bin").alias("bin")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sizes = {r[0]: r[1] for r in counts.groupBy("old_shard").agg(F.sum("bytes")).limit(max_shards + 1).collect()}
    if len(sizes) > max_shards:
        raise ValueError(f"more than {max_shards} old shards")
    total = sum(sizes.values())
    goes = transfers(sizes, [total // n_new + (j < total % n_new) for j in range(n_new)])
    plan = []
    for i, parts in goes.items():
        at = 0
        for j, units in parts:
            plan.append((i, at, at + units, j))
            at += units
    spark = docs.sparkSession
    plan_ = spark.createDataFrame(plan, "old_shard int, lo long, hi long, shard int")  # a row a piece
    # blocks follow the order of places: by size, then by the hash's share of its range
    split = counts.select("old_shard", "bin", F.ceil(F.col("n") / block_rows).cast("int").alias("k"))
    share = (F.col("at.h") / F.lit(2.0**64) + 0.5) * F.col("k")
    rows = rows.withColumn("bin", F.col("at.bin")).join(split, ["old_shard", "bin"]).withColumn("sub", F.floor(share).cast("int"))
    block = ["old_shard", "bin", "sub"]
    before = Window.partitionBy("old_shard").orderBy("bin", "sub").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*block).agg(F.sum("size").alias("bytes")).select(*block, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("size").over(inside)).join(base, block)
    # twice the middle of the document's bytes, as a whole number
    placed = placed.withColumn("middle", 2 * (F.col("base") + F.col("end")) - F.col("size"))
    pieces = F.broadcast(plan_.groupBy("old_shard").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("pieces")))  # one row an old shard
    hit = F.filter("pieces", lambda c: (2 * c["lo"] <= F.col("middle")) & (F.col("middle") < 2 * c["hi"]))[0]
    placed = placed.join(pieces, "old_shard").select("old_shard", hit["lo"].alias("lo"), hit["shard"].alias("shard"), "at")
    firsts = placed.groupBy("old_shard", "lo", "shard").agg(F.min("at").alias("first")).select("old_shard", "first", "shard")
    return Resharding(stable(firsts), old_shard, key, text)


def slots(placed: DataFrame, n_shards: int, rows_each: int = 500) -> DataFrame:
    """placed (doc_id, text_crc32, size, shard and more) with slot: rows of a shard numbered from 0 without gaps, in the
    order of a hash; counts of about rows_each rows and ranks among those, so no task holds a shard. Rows that share an id
    and a text, null or not, are numbered like any other, one after the other; other columns stay, no rows give none."""
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(pieces_of(placed.count(), n_shards * rows_each))).cast("int"))
    number = placed.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    number = number.select("shard", "_block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("_rank", rank).join(number, ["shard", "_block"])
    return out.withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_block", "_rank", "_before")


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def rewrite_shards(docs: DataFrame, plan: Resharding, path: str, file_rows: int = 50_000) -> list[int]:
    """Writes path/shard=N/ from docs for the shards that gain or lose rows and for those that path lacks, and returns
    those shards.

    A shard that is there and whose rows all stay keeps its files. A row's new shard is known where it is read, so its
    text moves once, to the tasks of its shard, which take at most about file_rows rows each. A shard that loses all its
    rows loses its folder, after all others are in place; until then a broken run can be run again. Null ids and texts and
    repeated rows are written as they are, each as often as it is there; other columns too, but for _old, _size, _crc and
    shard. Without rows nothing is written, so path may not exist then.
    """
    placed = plan.place(docs)
    found = stable(placed.groupBy("_old", "shard").agg(F.count("*").alias("n"))).collect()  # a row a piece
    rows: dict[int, int] = {}
    for r in found:
        rows[r["shard"]] = rows.get(r["shard"], 0) + r["n"]
    spark = docs.sparkSession

    def lacks(shard: int) -> bool:
        files, at = _folder(spark, f"{path}/shard={shard}")
        return not files.exists(at)

    moved = {x for r in found if r["_old"] != r["shard"] for x in (r["_old"], r["shard"]) if x >= 0}
    touched = sorted(moved | {x for x in rows if lacks(x)})
    if not touched:
        return []
    parts = pieces_of(max(rows.values()), file_rows)
    out = placed.join(F.broadcast(spark.createDataFrame([(x,) for x in touched], "shard int")), "shard", "left_semi").drop("_old", "_size")
    part = F.pmod(F.xxhash64("_crc"), F.lit(parts))
    out = out.repartition(len(rows) * parts, "shard", part).drop("_crc").sortWithinPartitions("shard")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for shard in touched:
        if shard not in rows:
            files, at = _folder(spark, f"{path}/shard={shard}")
            files.delete(at, True)
    return touched


#: The layout that op4 starts from, and the one that it makes.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt into 32 shards by a hash, written as 40 shards and read from those files, which go once their
    rows are counted: as many must come back as there were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/op4-{uuid.uuid4().hex}"
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int")
    schema = "doc_id long, text string, shard int"
    back = spark.read.schema(schema).parquet(path) if rewrite_shards(docs, reshard(docs, old, NEW_SHARDS), path) else spark.createDataFrame([], schema)
    placed = stable(back.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard"))
    before, after = docs.count(), placed.count()
    if before != after:
        raise RuntimeError(f"{after} of {before} rows came back from {path}")
    files, at = _folder(spark, path)
    files.delete(at, True)
    return slots(placed, NEW_SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"))
