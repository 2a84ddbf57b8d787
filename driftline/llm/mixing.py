"""Mixing sources to target weights by fixed-length blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import pieces_of, stable, table, words


def shares(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Targets that share total by weight, none above most times its size; what a full one leaves goes to the rest."""
    out, full = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(out[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = []
        for i, w in enumerate(weights):
            if i not in full:
                out[i] = rest * w / weight
                if out[i] > most * sizes[i]:
                    over.append(i)
        if not over:
            return out
        for i in over:
            out[i] = float(most * sizes[i])
            full.add(i)
        if len(full) == len(sizes):
            return out


def draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slot counts by output shard and source: multinomial over what each source has left, so that totals are met."""
    rng = np.random.default_rng(seed)
    left = np.asarray(slots, np.int64)
    total = int(left.sum())
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        need = total // shards + (k < total % shards)
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of index i of 0..n-1 under the pseudorandom permutation named by key (elementwise).

    A Feistel network of four rounds over the smallest even number of bits that holds n; values at or above n walk on.
    """
    i, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            z = (right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        with np.errstate(over="ignore"):
            at, n = pdf["m"].to_numpy() % pdf["n_blocks"].to_numpy(), pdf["n_blocks"].to_numpy()
            epoch = pdf["m"].to_numpy() // n
            key = pdf["seed"].to_numpy().astype(np.uint64) + epoch.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            yield pd.DataFrame({"src": pdf["src"], "block": permuted(at, n, key), "epoch": epoch, "out_shard": pdf["out_shard"], "slot": pdf["slot"]})


class Mix:
    """sizes: doc_id, row, src, size, start (in its source), step (words of its source's blocks). sources: src, source, source_size, target. slots: src,
    block, epoch, out_shard, slot. pieces: row, src, block, lo, hi (words of the document that the block holds)."""

    def __init__(self, sizes: DataFrame, sources: DataFrame, slots: DataFrame):
        self.sizes, self.sources, self.slots = sizes, sources, slots
        self._repeated: bool | None = None
        step = F.col("step")
        first, last = F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("size") - 1) / step)
        pieces = sizes.where("size > 0").select("row", "src", "start", "size", "step", F.explode(F.sequence(first, last)).alias("block"))
        lo, hi = F.greatest(F.col("block") * step - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * step - F.col("start"), F.col("size"))
        self.pieces = pieces.select("row", "src", "block", lo.alias("lo"), hi.alias("hi"))

    @property
    def repeated(self) -> bool:
        """Whether any id and text stand on several rows."""
        if self._repeated is None:
            self._repeated = not self.sizes.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        return self._repeated

    def taken(self) -> DataFrame:
        """row, taken: the words that the mix takes from each document, repeats counted. Slots are spread out from a small
        plan, which Spark would take for a small table: the hint keeps it from broadcasting them."""
        n = self.slots.groupBy("src", "block").agg(F.count("*").alias("n"))
        return self.pieces.join(n.hint("merge"), ["src", "block"]).groupBy("row").agg(F.sum(F.col("n") * (F.col("hi") - F.col("lo"))).alias("taken"))

    def parts(self) -> DataFrame:
        """row, epoch, spans: the word spans [lo, hi) that each pass over a source takes from a document, joined where
        they touch."""
        hits = self.pieces.join(self.slots.select("src", "block", "epoch").hint("merge"), ["src", "block"])
        return hits.groupBy("row", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 128, shards: int = 64, seed: int = 20, chunk_rows: int = 400, max_sources: int = 100_000, key: str = "doc_id", source: str = "source", text: str = "text") -> Mix:
    """The mix of docs: which blocks of `block` words each output shard takes from each source; a source of fewer than 64
    such blocks has shorter ones, a 64th of its words, so that it comes as near to its target as a large one.

    Only one row a source reaches the driver, at most max_sources. A source's words are the documents' words laid end to
    end in the order of a hash; offsets are sums over chunks plus a sum within one chunk, so no task holds a source.
    A source's slots run through its blocks in a new pseudorandom order on each pass, so no block is taken more than
    `most` times and the words taken differ from the target by less than a block. A null text has no words, a null
    source is a source of its own that comes last, rows with a null or repeated id are documents of their own.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stable(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(body)).cast("long").alias("size"), F.xxhash64(body).alias("t")))
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in found]
    target = shares(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most) if found else []
    steps = [max(1, min(block, s // 64)) for s in sizes]
    n_blocks = [-(-s // n) for s, n in zip(sizes, steps, strict=True)]
    slots = [min(round(t / s * b), most * b) if s else 0 for t, s, b in zip(target, sizes, n_blocks, strict=True)]
    names = spark.createDataFrame([(i, r["source"], r["source_size"], t) for i, (r, t) in enumerate(zip(found, target, strict=True))], "src int, source string, source_size long, target double")
    total = sum(r["n"] for r in found)
    chunk = F.pmod(F.xxhash64("doc_id", "t"), F.lit(pieces_of(total, chunk_rows))).cast("int")
    steps_ = spark.createDataFrame(list(enumerate(steps)), "src int, step long")
    names_ = F.broadcast(names.join(steps_, "src").select("src", "step", F.col("source").alias("s")))  # at most max_sources rows
    rows = rows.join(names_, rows["source"].eqNullSafe(names_["s"])).select("doc_id", "src", "step", "size", "t", chunk.alias("chunk"))
    base = rows.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("src", "chunk", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    order = Window.partitionBy("src", "chunk").orderBy("doc_id", "t")
    rows = rows.withColumns({"turn": F.row_number().over(order), "end": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    rows = rows.join(base, ["src", "chunk"])
    rows = rows.select("doc_id", "t", F.struct("src", "chunk", "turn").alias("row"), "src", "step", "size", (F.col("base") + F.col("end") - F.col("size")).alias("start"))
    plan, at = [], np.zeros(len(found), np.int64)
    for k, counts in enumerate(draws(slots, shards, seed) if sum(slots) else []):
        where = 0
        for i, c in enumerate(counts.tolist()):
            if c:
                seed_i = int.from_bytes(hashlib.blake2b(f"{seed}|{found[i]['source']}".encode(), digest_size=7).digest(), "big")
                plan.append((k, i, int(at[i]), c, where, n_blocks[i], seed_i))
                at[i] += c
                where += c
    runs = spark.createDataFrame(plan, "out_shard int, src int, first long, n long, at long, n_blocks long, seed long")
    # long runs are cut before each is spread out, so that no row makes more than 4096
    runs = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))).alias("lo")).repartition("out_shard", "src", "lo")
    one = F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + 4095, F.col("n") - 1)))
    slots_ = runs.select("out_shard", "src", "first", "at", "n_blocks", "seed", one.alias("j"))
    slots_ = slots_.select("out_shard", "src", "n_blocks", "seed", (F.col("first") + F.col("j")).alias("m"), (F.col("at") + F.col("j")).alias("slot"))
    slots_ = slots_.mapInPandas(_blocks, "src int, block long, epoch long, out_shard int, slot long")
    return Mix(stable(rows), names, slots_)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = m.sizes.join(m.taken(), "row", "left").join(F.broadcast(m.sources), "src")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
