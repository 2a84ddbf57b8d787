"""Embedding near-duplicates by product quantisation over inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import components, local_roots, stable, table

#: Cells of a table of vectors against lists: 8 MB.
CELLS = 1 << 20


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


@dataclass(frozen=True)
class Index:
    """Coarse centroids, and for each subspace of the residuals its codewords."""

    lists: np.ndarray  # lists x dims
    words: tuple[np.ndarray, ...]  # per subspace: codewords x dims of the subspace
    cuts: tuple[int, ...]
    radius: float  # distance of unit vectors at the threshold
    margin: float

    @property
    def dims(self) -> int:
        return self.lists.shape[1]

    def probes(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list of each unit vector, and (row, list) of the other lists to look into: those whose border is within
        the margin. So many vectors at a time that their tables against all lists have about CELLS cells."""
        squares = (self.lists**2).sum(1)
        homes, rows, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        each = max(1, CELLS // len(self.lists))
        for at in range(0, len(u), each):
            part = u[at : at + each]
            d = np.maximum((part * part).sum(1)[:, None] + squares[None, :] - 2 * (part @ self.lists.T), 0)
            home = d.argmin(1)
            seen, where = np.unique(home, return_inverse=True)
            apart = np.sqrt(np.maximum(squares[seen][:, None] + squares[None, :] - 2 * self.lists[seen] @ self.lists.T, 0))
            border = d - d[np.arange(len(part)), home][:, None] <= 2 * self.margin * apart[where]
            border[np.arange(len(part)), home] = False
            row, other = np.nonzero(border)
            homes.append(home)
            rows.append(row + at)
            others.append(other)
        return np.concatenate(homes), np.concatenate(rows), np.concatenate(others)

    def asks(self, u: np.ndarray, home: int, other: np.ndarray) -> np.ndarray:
        """Whether unit vectors at home in one list look into the other lists, by the rule of probes."""
        far = lambda c: ((u - c) ** 2).sum(1)
        apart = np.sqrt(((self.lists[home] - self.lists[other]) ** 2).sum(1))
        return far(self.lists[other]) - far(self.lists[home]) <= 2 * self.margin * apart

    def encode(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residual[:, a:b], w) for a, b, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], 1)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each residual's parts to the codewords."""
        return [np.maximum((residual[:, a:b] ** 2).sum(1)[:, None] + (w * w).sum(1)[None, :] - 2 * residual[:, a:b] @ w.T, 0) for a, b, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)]


def fit(sample: np.ndarray, n: int, threshold: float, max_lists: int, subspaces: int, codewords: int, slack: float, seed: int = 5) -> Index:
    lists = kmeans(sample, max(1, min(max_lists, int(math.sqrt(n)), len(sample) // 4 or 1)), 8, seed)
    residual = sample - lists[nearest(sample, lists)]
    m = min(subspaces, sample.shape[1])
    cuts = tuple(round(i * sample.shape[1] / m) for i in range(m + 1))
    words = tuple(kmeans(residual[:, a:b], codewords, 6, seed + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1))
    radius = math.sqrt(2 - 2 * threshold)
    return Index(lists, words, cuts, radius, slack * radius)


def _unit(vectors: pd.Series, dims: int) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), "<f8").reshape(-1, dims)
    return v / np.linalg.norm(v, axis=1)[:, None]


def vector_links(vectors: DataFrame, threshold: float = 0.9, sample_rows: int = 16_384, max_lists: int = 4096, subspaces: int = 8, codewords: int = 256, slack: float = 0.3, block: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): for each row the number of other rows whose cosine with it is at least
    threshold, and the smallest id that links reach.

    Equal vectors are one node that counts for as many rows. The index is fitted on at most sample_rows vectors, chosen
    by a hash; every vector is listed and asked for. A vector looks into its home list and into each list whose border
    is within slack times the threshold's distance, so nearly all partners are met; a link that only one end finds counts
    at both. In a list a table lookup bounds the
    distance from below by the coded distance less the coding error kept with each entry; what may lie within the
    threshold is verified by the cosine in double precision, so nothing below it links. Long lists are cut into blocks,
    and what leaves a block is a count and a root for each vector, not pairs.

    A vector that is null, empty, zero, of another length than most, or holds a null or a non-finite value links with
    nothing, and neither does a row with a null id, whose component_id is null. Extra columns play no part.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("v")).alias("v"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    common = rows.where("v is not null").groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims = common["dims"] if common else 0
    usable = rows.where((F.col("v").isNotNull()) & (F.size("v") == dims))
    nodes = usable.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stable(nodes.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    if not n:
        return vectors.select(F.col(key).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.col(key).isNotNull().alias("kept"))
    # the index is fitted here on a bounded sample
    chosen = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 40)) <= int(min(1.0, 0.9 * sample_rows / n) * (1 << 40)) if n > sample_rows else F.lit(True)
    top = nodes.where(chosen).limit(sample_rows).orderBy("h1", "h2").select("v").toPandas()["v"]
    sample = np.stack((top if len(top) else nodes.limit(1).toPandas()["v"]).to_numpy()).astype(np.float64)
    index = fit(sample / np.linalg.norm(sample, axis=1)[:, None], n, threshold, max_lists, subspaces, codewords, slack)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [np.asarray(x, "<f8").tobytes() for x in pdf["v"]]
            u = _unit(pd.Series(data), index.dims)
            home, row, other = index.probes(u)
            residual = u - index.lists[home]
            codes = index.encode(residual)
            error = np.linalg.norm(residual - index.decode(codes), axis=1)
            node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
            yield pd.DataFrame({"list": home, "entry": True, "home": home, "node": node, "copies": copies, "data": data, "code": [c.tobytes() for c in codes], "error": error})
            row = np.concatenate([np.arange(len(u)), row])
            to = np.concatenate([home, other])
            yield pd.DataFrame({"list": to, "entry": False, "home": home[row], "node": node[row], "copies": copies[row], "data": [data[i] for i in row], "code": b"", "error": 0.0})

    each = nodes.select("node", "copies", "v").mapInPandas(listed, "list int, entry boolean, home int, node long, copies long, data binary, code binary, error double")
    each = stable(each)
    counts = each.groupBy("list").agg(F.ceil(F.sum(F.col("entry").cast("int")) / block).cast("int").alias("e"), F.ceil(F.sum((~F.col("entry")).cast("int")) / (2 * block)).cast("int").alias("q")).where("e > 0 and q > 0")
    # an entry goes to every block of questions of its list, a question to every block of entries
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    each = each.join(counts, "list")
    ecuts = F.when(F.col("entry"), F.array(part("e"))).otherwise(F.sequence(F.lit(0), F.col("e") - 1))
    qcuts = F.when(F.col("entry"), F.sequence(F.lit(0), F.col("q") - 1)).otherwise(F.array(part("q")))
    each = each.withColumn("eb", F.explode(ecuts)).withColumn("qb", F.explode(qcuts)).drop("e", "q")

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        entries, asks = pdf[pdf["entry"]], pdf[~pdf["entry"]]
        if not len(entries) or not len(asks):
            return pd.DataFrame({"node": [], "n": [], "root": []})
        x, q = _unit(entries["data"], index.dims), _unit(asks["data"], index.dims)
        codes = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(x), -1)
        reach = (index.radius + entries["error"].to_numpy() + 1e-9) ** 2
        xn, qn, copies = entries["node"].to_numpy(), asks["node"].to_numpy(), entries["copies"].to_numpy()
        home, times = asks["home"].to_numpy(), asks["copies"].to_numpy()
        here = int(pdf["list"].iloc[0])
        centre = index.lists[here]
        count, back, left, right = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64), [], []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            coded = np.zeros((len(part), len(x)))
            for j, t in enumerate(index.tables(part - centre)):
                coded += t[:, codes[:, j]]
            i, k = np.nonzero(coded <= reach[None, :])
            same = qn[at + i] != xn[k]
            i, k = i[same], k[same]
            for lo in range(0, len(i), 65_536):  # the exact cosine, some at a time
                a, b = i[lo : lo + 65_536], k[lo : lo + 65_536]
                hit = np.einsum("ij,ij->i", part[a], x[b]) >= threshold
                a, b = a[hit], b[hit]
                np.add.at(count, at + a, copies[b])
                # an entry that does not ask in the other's home list hears of the link here
                deaf = home[at + a] != here
                deaf[deaf] = ~index.asks(x[b[deaf]], here, home[at + a[deaf]])
                np.add.at(back, b[deaf], times[at + a[deaf]])
                left.append(at + a)
                right.append(b)
        left, right = np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])
        names, at = np.unique(np.concatenate([qn, xn]), return_inverse=True)
        root = local_roots(at[left], at[len(qn) + right], len(names)) if len(left) else np.arange(len(names))
        n_by = np.zeros(len(names), np.int64)
        np.add.at(n_by, at[: len(qn)], count)
        np.add.at(n_by, at[len(qn) :], back)
        keep = (n_by > 0) | (root != np.arange(len(names)))
        return pd.DataFrame({"node": names[keep], "n": n_by[keep], "root": names[root[keep]]})

    found = stable(each.groupBy("list", "eb", "qb").applyInPandas(matched, "node long, n long, root long"))
    n_links = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    who = nodes.select("node", "h1", "h2", "least", "copies").join(n_links, "node", "left").join(roots, "node", "left")
    who = stable(who.select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    first = who.groupBy("root").agg(F.min("least").alias("component_id"))
    who = who.join(first, "root").select("h1", "h2", "n_links", "component_id")
    linked = usable.select("vec_id", "h1", "h2").join(who, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull() | (F.size("v") != dims)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS seen FROM e UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, (SELECT min(seen) FROM r WHERE r.node = e.vec_id) AS component_id,
  vec_id = (SELECT min(seen) FROM r WHERE r.node = e.vec_id) AS kept
FROM e
"""
