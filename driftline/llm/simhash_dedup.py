"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import ascii_lower, components, hex16, local_roots, pieces_of, shingles, slices, split_join, stable, table, vote_sums, voted, words


def fingerprints(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, copies, fp): by id and text, the number of rows and the majority of the 64 bits of the XXH64 of all k-word
    shingles of the text with A-Z lower-cased, repeats included; zero for no word."""
    body = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.col(key).alias("d"), F.xxhash64(body).alias("t"), F.posexplode_outer(shingles(ascii_lower(body), k)).alias("at", "s"))
    sums = each.select("d", "t", "at", F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h")).groupBy("d", "t").agg(
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"), F.count("h").alias("n"), *vote_sums(F.col("h"), F.lit(1).cast("long")))
    return sums.select("d", "t", "copies", F.coalesce(voted(F.col("n")), F.lit(0).cast("long")).alias("fp"))


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


class Segments:
    """64 bits cut into n segments, each with a radius: two fingerprints within `radius` bits of each other differ, in
    some segment, in at most that segment's bits. The radii sum to radius - n + 1, which is just enough for that."""

    def __init__(self, radius: int, n: int):
        at = [round(i * 64 / n) for i in range(n + 1)]
        self.bits = [list(range(a, b)) for a, b in zip(at, at[1:], strict=False)]
        rest = max(0, radius - n + 1)
        self.radii = [rest // n + (i < rest % n) for i in range(n)]

    def table(self, fps: DataFrame, *also: str) -> DataFrame:
        """(fp, also, s, j, key): the value of segment s with j of its bits turned, for j up to the segment's radius; j = 0
        is the table entry, the others probe for entries. Of two values that differ, the one that has the lowest differing
        bit set probes for the other, so half a ball meets every pair once."""
        balls = []
        for s, (bits, r) in enumerate(zip(self.bits, self.radii, strict=True)):
            for j in range(r + 1):
                balls += [(s, j, _mask(list(c)), _mask(list(c[:1])), _mask(bits), bits[0]) for c in combinations(bits, j)]
        ball = "array(" + ",".join(f"named_struct('s',{s},'j',{j},'m',{_sql(m)},'low',{_sql(low)},'own',{_sql(own)},'at',{at})" for s, j, m, low, own, at in balls) + ")"
        each = fps.select("fp", *also, F.explode(F.expr(ball)).alias("x")).where("x.j = 0 or (fp & x.low) <> 0")
        return each.select("fp", *also, "x.s", "x.j", F.expr("(cast(x.s as long) << 40) + shiftrightunsigned((fp ^ x.m) & x.own, x.at)").alias("key"))

    def ball(self, s: int, radius: int) -> list[int]:
        """Masks of at most radius bits outside segment s."""
        rest = [b for i, bits in enumerate(self.bits) if i != s for b in bits]
        return [_mask(list(c)) for r in range(radius + 1) for c in combinations(rest, r)]


def _sql(m: int) -> str:
    return f"{m}L" if m > -(1 << 63) else "(-9223372036854775807L - 1L)"


def links(fps: DataFrame, radius: int = 4, crowd: int = 64, segments: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long) that differ in at most radius bits: every such pair is an
    edge or is joined by edges through fingerprints that link in turn; no edge joins two that don't link.

    Table entries hold each fingerprint under its segments, probes ask for the ball around each segment, and matches are
    verified by their whole distance. One shuffle by key brings entries and probes together. Two segments of 32 bits
    stand in for three of 21 where there are so many fingerprints that short keys would be crowded by chance.

    A key under which more than `crowd` fingerprints stand would make pairs with the square of their number. Those
    instead write down the patterns near them outside the segment: an entry all within half the radius, a probe with j
    turned bits all within j less. Any two that share a pattern differ in at most radius bits, and any two that link
    through this key share one; so each is tied to the smallest that shares its pattern, in a number of rows that grows
    with the group and not with its square.

    Fingerprints come once each; none give no edges, other columns play no part.
    """
    if radius < 2 or radius % 2:
        raise ValueError("radius must be even and at least 2")
    if segments is None:
        segments = radius // 2 + 1 if radius > 2 and fps.count() <= 1 << 25 else 2
    seg = Segments(radius, segments)
    # both joins below read this one shuffle
    table_ = seg.table(fps).repartition("key")
    entries = seg.table(fps).where("j = 0").select("fp", "key")
    counts = stable(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    few = entries.join(counts, "key", "left_anti").select(F.col("key").alias("_key"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    once = (F.col("j") > 0) | (F.col("fp") < F.col("b"))
    pairs = table_.join(few.hint("merge"), (F.col("key") == F.col("_key")) & once & near).select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))
    half = radius // 2
    many = table_.join(counts.hint("merge"), "key")
    masks = lambda s, r: F.lit(seg.ball(s, r)).cast("array<bigint>")
    pick = F.coalesce(*[F.when((F.col("s") == s) & (F.col("j") == j), masks(s, half - j)) for s, r in enumerate(seg.radii) for j in range(r + 1)])
    own = F.coalesce(*[F.when(F.col("s") == s, F.lit(_mask(bits)).cast("long")) for s, bits in enumerate(seg.bits)])
    # a key and what stands outside its segment
    patterns = many.select("fp", "key", F.col("fp").bitwiseAND(F.bitwise_not(own)).alias("rest"), F.explode(pick).alias("m")).select("fp", "key", F.col("rest").bitwiseXOR(F.col("m")).alias("p"))
    least = patterns.groupBy("key", "p").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
    stars = patterns.join(least, ["key", "p"]).where("fp <> b").select(F.col("b").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def groups(docs: DataFrame, k: int, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, copies, fp, component_id): component_id is the smallest id reachable by links of fingerprints.

    Equal fingerprints are one node, so copies cost one row each and no pairs. A null text has no words; texts without
    words share the fingerprint zero and link like any others. A null id takes part in its group and is never its
    smallest id, unless there is no other. Rows that share an id and a text are one row with their number in copies.
    An empty table has no groups; other columns do not come back, whatever they are called.
    """
    fps = stable(fingerprints(docs, k, key, text))
    nodes = fps.groupBy("fp").agg(F.min("d").alias("least"))
    found = components(links(nodes.select("fp"), radius))
    roots = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = stable(roots)
    label = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(split_join(roots, label, ["root"]).select("fp", "component_id"), "fp")


def _runs(x: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, in order, of all runs of k words, given the words' hashes; of the whole text if it has fewer."""
    x = np.asarray(x, np.int64).view(np.uint64)
    runs = np.zeros(max(0, min(len(x), len(x) - k + 1)) or min(1, len(x)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(x))):
            runs = _mixed(runs * np.uint64(0x9FB21C651E98DF25) + x[i : i + len(runs)])
    return np.unique(runs)


#: Sets of few shingles stand this many times in their votes: by so many votes the bits of two sets differ as the angle
#: between the sets says, which single votes of four or five shingles don't.
COPIES = 16


def _majority(votes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Bits set in more than half of the votes' hashes under each seed, a word a seed."""
    total = np.zeros(64 * len(seeds), np.int64)
    for at in range(0, len(votes), 255):  # as many as single bytes can count
        bits = np.unpackbits(_mixed(votes[at : at + 255, None] + seeds).view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(votes), bitorder="little").view(np.int64)


def _wide(k: int, hashes: int, fingerprints: int, few: int, most_few: int):
    """Per text, over its distinct k-word shingles: the hash of their set, their number, `hashes` words of majority bits,
    and its fingerprints, `fingerprints` words of one form, of which the first has number `first`. Sets of at most `few`
    shingles have the form of few ones, whose numbers begin at `fingerprints`, larger ones the other; those of at most
    `most_few` have both. None for no word."""
    seeds = lambda n, first: np.asarray([(first + i + 1) * 0x9E3779B97F4A7C15 % 2**64 for i in range(n)], np.uint64)
    of_bits, of_few, of_copies = seeds(max(hashes, fingerprints), 0), seeds(fingerprints, 1000), seeds(COPIES, 2000)

    def sketch(h: np.ndarray) -> tuple[list[int], int, list[int]]:
        own = _majority(h, of_bits if len(h) > few else of_bits[:hashes])
        found = [own[:fingerprints]] if len(h) > few else []
        if 0 < len(h) <= most_few:
            found.append(_majority(_mixed(h[:, None] ^ of_copies).ravel(), of_few))
        return own[:hashes].tolist(), 0 if len(h) > few else fingerprints, np.concatenate([own[:0], *found]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "t", "node", "n", *[f"f{i}" for i in range(hashes)], "first", "fps"]
        for part in slices(batches, "w", 1 << 20):
            w = part.column("w")
            edges, words_ = w.offsets.to_numpy(), w.values.to_numpy()
            node, n, bits, first, fps = [], [], [], [], []
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                h = _runs(words_[a:b], k)
                with np.errstate(over="ignore"):
                    node.append(_mixed(h + np.uint64(len(h))).sum(dtype=np.uint64))
                n.append(len(h))
                f, at, own = sketch(h)
                bits.append(f)
                first.append(at)
                fps.append(own)
            columns = [np.asarray(node, np.uint64).view(np.int64), np.asarray(n, np.int64), *np.asarray(bits, np.int64).reshape(-1, hashes).T, np.asarray(first, np.int64)]
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), *[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(fps, pa.list_(pa.int64()))], names)

    return run


def _share(similarity: float) -> float:
    """The share of SimHash bits that differ between sets of equal size and this similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _most(bits: int, share: float) -> int:
    """Differing bits, four standard deviations above what the share gives."""
    return math.floor(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def independent(similarity: float, segments: int, missed: float = 3e-6) -> int:
    """The number of 64-bit fingerprints of which pairs of the similarity have a segment in common, all but `missed`."""
    meets = (1 - _share(similarity)) ** max(map(len, Segments(segments - 1, segments).bits))
    return math.ceil(math.log(missed) / math.log1p(-meets) / segments)


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, hashes: int = 4, segments: int | None = None, crowd: int = 1024, block: int = 1024, few_shingles: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, copies, component_id, root): groups of texts linked by a Jaccard similarity of at least `similarity` of
    their sets of k-word shingles, found by SimHash and multi-index hashing; A-Z count as lower case.

    A text has a number of independent 64-bit SimHash fingerprints of its shingles, each cut into segments, and stands in
    a table under each segment's value. Pairs that share a value are verified by the distance of 128 bits. So pairs with
    less than `segments` differing bits in any fingerprint are sure to meet, and there are so many fingerprints that of
    all pairs of the similarity, wherever their differences lie, all but 3 in a million share a segment; by default
    segments have 16 bits, and 21 where there are so many texts that these would be crowded by chance. Sets of at most
    `few_shingles` meet under fingerprints of their own, in which each shingle votes more often (COPIES).

    A value under which more than about `crowd` texts stand is compared in blocks, and only a tree of the links comes
    back, never a pair a link. The coarse groups that these trees make are by distance: at the similarity the angle
    between two sets is known, and four standard deviations above the distance it gives still join. Inside the coarse
    groups, in blocks again, only pairs whose shingle hashes have the similarity link. Texts with equal sets are one
    node, named by the set's hash. Null texts and ids as in `groups`.
    """
    names = [f"f{i}" for i in range(hashes)]
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(body).alias("t"), F.transform(words(ascii_lower(body)), lambda w: F.xxhash64(w)).alias("w"))
    if segments is None:
        segments = 4 if docs.count() <= 1 << 24 else 3
    number = independent(similarity, segments)
    sketched = _wide(k, hashes, number, few_shingles, math.floor(few_shingles / similarity + 1e-9))
    made = stable(hashed.mapInArrow(sketched, "d long, t long, node long, n long, " + ", ".join(f"{c} long" for c in names) + ", first long, fps array<long>"))
    fps = made.groupBy("d", "t", "node").agg(F.count("*").alias("copies"))
    most = _most(64 * hashes, _share(similarity))
    # two words of the same form go along to verify by
    form = F.floor(F.col("at") / number) * number
    nodes = made.select("node", "first", "fps").where("size(fps) > 0").dropDuplicates(["node"])
    each = nodes.select("node", "first", "fps", F.posexplode("fps").alias("at", "fp"))
    each = each.select("fp", "node", (F.col("first") + F.col("at")).alias("i"), F.get("fps", form.cast("int")).alias("u"), F.get("fps", (form + 1).cast("int")).alias("v"))
    each = Segments(segments - 1, segments).table(each, "node", "i", "u", "v")
    each = each.select("node", "u", "v", F.shiftleft("i", 44).bitwiseOR(F.col("key")).alias("key"))
    many = in_block_pairs(each.join(crowded(each, crowd, block), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "key")
    # some hundred thousand rows of many values at a time: a frame gives an edge a node, however many values it is under
    frames = pieces_of(made.count() * number * segments, 400_000)
    frame = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(frames))
    trees = many.groupBy(frame.alias("frame")).applyInPandas(_meetings(_most(128, _share(similarity))), "a long, b long")

    def nodes_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        # unsigned: bitwise_count counts the bits of the absolute value
        return np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint64), pdf["n"].to_numpy(), pdf["node"].to_numpy(), pdf

    def exact(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """A tree of the links between the nodes of one coarse group."""
        x, size, node, pdf = nodes_of(pdf)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        found = [(np.zeros(0, int), np.zeros(0, int))] + list(near_rows(x, size, most, similarity, few_shingles))
        a, b = linked(sets, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), similarity)
        return node[a], node[b]

    def hashed_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="w").assign(shingles=[_runs(x, k).tobytes() for x in pdf["w"]])

    group = components(thinned(thinned(trees)))
    # one text of each node that a coarse group holds
    nodes = made.groupBy("node").agg(F.min(F.struct(F.col("d").isNull().alias("no"), "d", "t")).alias("x"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in names])
    chosen = stable(nodes.join(group, "node").select("node", "root", F.col("x.d").alias("_d"), F.col("x.t").alias("_t"), "n", *names))
    # blocks of at most about 16 MB of hashes
    sizes = chosen.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / 2_000_000)).cast("int").alias("blocks"))
    texts = docs.select(F.col(key).cast("long").alias("d"), body.alias("body")).withColumn("t", F.xxhash64("body"))
    texts = texts.join(chosen, (F.col("t") == F.col("_t")) & F.col("d").eqNullSafe(F.col("_d")))
    texts = texts.select("node", "root", "n", *names, F.transform(words(ascii_lower(F.col("body"))), lambda w: F.xxhash64(w)).alias("w"))
    sets = texts.mapInPandas(hashed_runs, "node long, root long, n long, " + ", ".join(f"{c} long" for c in names) + ", shingles binary")
    links_ = in_frames(in_block_pairs(sets.join(sizes, "root"), "root"), "root", exact, pieces_of(chosen.count(), 200))
    return labelled(fps, components(links_))


def crowded(rows: DataFrame, crowd: int, block: int, one_in: int = 16) -> DataFrame:
    """(key, blocks) of the keys with more than about `crowd` nodes, counted from one node in `one_in` by its hash: which
    they are decides only how many tasks compare a key's nodes. Checked to be few before they are broadcast."""
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    found = stable(some.where(F.col("n") * one_in > crowd).select("key", F.ceil(F.col("n") * one_in / block).cast("int").alias("blocks")))
    return F.broadcast(found) if found.count() <= 100_000 else found


def thinned(edges: DataFrame) -> DataFrame:
    """Edges with the same components and never more of them: a node keeps that to the smallest of its smaller neighbours,
    and the others hang on that one. Nodes of one group meet the same few smallest ones in many trees. A node has at most
    a neighbour for each tree that it is in."""
    each = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.collect_set("b").alias("over"), F.min("b").alias("b"))
    return each.select(F.explode(F.array_append("over", F.col("a"))).alias("a"), "b").where("a <> b").distinct()


def _meetings(most: int):
    """Of rows of many keys' blocks, a forest of the pairs of nodes that differ in at most `most` bits of u and v under
    one key. Each row is compared with the next one, the second next and so on, as long as any has the same key."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [pdf[c].to_numpy(np.int64) for c in ("hi", "lo", "key")]
        order = np.lexsort([pdf["node"].to_numpy(np.int64), *at])  # a tree hangs on its smallest node, under any key
        # equal numbers for one key's pair of blocks
        group = np.cumsum(np.logical_or.reduce([np.diff(c[order], prepend=c[order[:1]]) != 0 for c in at]))
        node, u, v = (pdf[c].to_numpy(np.int64)[order] for c in ("node", "u", "v"))
        u, v = u.view(np.uint64), v.view(np.uint64)
        root = np.arange(len(node))
        i, step = root, 0
        while len(i):
            step += 1
            i = i[i + step < len(node)]
            i = i[group[i] == group[i + step]]
            near = np.bitwise_count(u[i] ^ u[i + step]) + np.bitwise_count(v[i] ^ v[i + step]) <= most  # at most 128, a byte
            j = i[near]
            j = j[root[j] != root[j + step]]
            if len(j):
                root = local_roots(root[j], root[j + step], len(node))[root]
        # one forest for all keys: at most an edge a node
        each, at_ = np.unique(node, return_inverse=True)
        over = local_roots(at_, at_[root], len(each))
        keep = over != np.arange(len(each))
        return pd.DataFrame({"a": each[keep], "b": each[over[keep]]})

    return tree


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) with i < j and at least the similarity that make a forest with the same components as
    all such pairs: pairs inside a component known so far are not compared."""
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    a, b = [], []
    root, each = np.arange(len(sets)), 1
    while len(i):
        first = np.searchsorted(j, j)
        now = np.arange(len(j)) - first < each  # some pairs of each j, twice as many each time
        ok = []
        for p, q in zip(i[now].tolist(), j[now].tolist(), strict=True):
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            ok.append(both >= similarity * (len(sets[p]) + len(sets[q]) - both) - 1e-9)
        p, q = i[now][np.asarray(ok, bool)], j[now][np.asarray(ok, bool)]
        a.append(p)
        b.append(q)
        root = local_roots(root[p], root[q], len(sets))[root]
        open_ = ~now & (root[i] != root[j])
        i, j, each = i[open_], j[open_], 2 * each
    none = np.zeros(0, int)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def in_block_pairs(rows: DataFrame, by: str) -> DataFrame:
    """Rows with a number of blocks, once for each pair of blocks (lo, hi) that theirs is in: every two rows under the
    same `by` meet in some pair."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("own", "with", "blocks")


def in_frames(rows: DataFrame, by: str, tree: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], frames: int) -> DataFrame:
    """Edges (a, b) that `tree` finds among the rows of each pair of blocks."""

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([by, "lo", "hi"], kind="stable").reset_index(drop=True)
        at = pdf[[by, "lo", "hi"]].to_numpy(np.int64)
        edges = [0, *(np.nonzero((at[1:] != at[:-1]).any(1))[0] + 1).tolist(), len(at)]
        found = [tree(pdf.iloc[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        ends = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)], 1), axis=0)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy(F.pmod(F.xxhash64(by, "lo", "hi"), F.lit(frames)).alias("frame")).applyInPandas(matched, "a long, b long")


def near_rows(x: np.ndarray, size: np.ndarray, most: int, similarity: float, few: int, part: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of sets that may have the similarity: by size, and by at most `most` differing bits of x unless one of
    them has no more than `few` shingles. Some rows at a time."""
    for lo in range(0, len(x), part):
        d = np.zeros((len(x[lo : lo + part]), len(x) - lo), np.int64)
        for c in range(x.shape[1]):
            d += np.bitwise_count(x[lo : lo + part, c, None] ^ x[None, lo:, c])
        m, n = size[lo : lo + part, None], size[None, lo:]
        alike = np.minimum(m, n) >= np.maximum(m, n) * similarity - 1e-9
        i, j = np.nonzero(alike & ((d <= most) | (np.minimum(m, n) <= few)))
        yield i[i < j] + lo, j[i < j] + lo


def labelled(fps: DataFrame, found: DataFrame) -> DataFrame:
    """fps with the component of each node: its root, and the smallest id in it."""
    rooted = stable(fps.join(found, "node", "left").select("d", "t", "copies", F.coalesce("root", "node").alias("root")))
    return split_join(rooted, rooted.groupBy("root").agg(F.min("d").alias("component_id")), ["root"])


def keep_one(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of found: the one with the smallest id (of several texts with that id, the one
    with the smallest hash; ids before nulls). All columns stay."""
    win = stable(found.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("no"), "d", "t", "copies")).alias("x")))
    win = win.select(F.col("x.d").alias("_d"), F.col("x.t").alias("_t"), F.col("x.copies").alias("_copies"))
    rows = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    semi = lambda w: rows.join(w, rows[key].eqNullSafe(w["_d"]) & (rows["_hash"] == w["_t"]), "left_semi")
    more = win.where("_copies > 1")
    if more.isEmpty():
        return semi(win).drop("_hash")
    return semi(win.where("_copies = 1")).unionByName(semi(more).dropDuplicates([key, "_hash"])).drop("_hash")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"), 4)
    each = found.select(F.col("d").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.drop("copy")
