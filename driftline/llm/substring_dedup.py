"""Removal of long word sequences that repeat in a corpus, over a graph of sampled k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import hot_keys, split_join, stable, table, words

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base][:n]


class Sequence:
    """The word hashes of some documents end to end, with hashes of any span in constant time."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = np.asarray([len(d) for d in docs], np.int64)
        self.x = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.doc = np.repeat(np.arange(len(docs)), self.n)
        self.sums = []
        for b in _BASES:
            s = np.zeros(len(self.x) + 1, np.uint64)
            np.cumsum(self.x * _powers(b, len(self.x)), out=s[1:])
            self.sums.append(s)

    def span(self, i: np.ndarray, j: np.ndarray, which: int = 0) -> np.ndarray:
        """A hash of the words i..j-1 that doesn't depend on where they stand."""
        s = self.sums[which]
        z = (s[j] - s[i]) * _powers(_INVERSE[which], len(s))[i]
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def label(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits: a long and an int."""
        return self.span(i, j).view(np.int64), (self.span(i, j, 1) >> np.uint64(33)).astype(np.int32)

    def windows(self, length: int) -> np.ndarray:
        """Where windows of that length start."""
        i = np.arange(max(0, len(self.x) - length + 1))
        return i[i + length <= self.end[self.doc[i]]] if len(i) else i

    def anchors(self, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For the windows that start at `at`, the place of the k-mer with the least hash (the first of equals); and all
        k-mer hashes. Equal windows have it at the same offset."""
        i = np.arange(max(0, len(self.x) - k + 1))
        kmers = self.span(i, i + k)
        width = length - k + 1
        low = np.uint64((1 << 24) - 1)
        out = np.empty(len(at), np.int64)
        step = 1 << 23
        for base in range(0, len(kmers), step):
            part = kmers[base : base + step + width - 1]
            m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
            have = 1
            while 2 * have <= width:
                m = np.minimum(m[:-have], m[have:])
                have *= 2
            if have < width:
                m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
            here = slice(np.searchsorted(at, base), np.searchsorted(at, base + step))
            out[here] = (m[at[here] - base] & low).astype(np.int64) + base
        return out, kmers


def _slices(docs: list[np.ndarray], most: int = 1 << 20) -> Iterator[slice]:
    at = n = 0
    for i, d in enumerate(docs):
        if n and n + len(d) > most:
            yield slice(at, i)
            at, n = i, 0
        n += len(d)
    if at < len(docs):
        yield slice(at, len(docs))


def _paths(length: int, k: int):
    """Sampled k-mers of each document with the path that leads on from each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, d, t = pdf["w"].tolist(), pdf["d"].to_numpy(), pdf["t"].to_numpy()
            for part in _slices(docs):
                seq = Sequence(docs[part])
                at = seq.windows(length)
                if not len(at):
                    continue
                place, kmers = seq.anchors(at, length, k)
                a = np.unique(np.concatenate([place, seq.start[seq.n >= length]]))
                doc = seq.doc[a]
                end, last = seq.end[doc], seq.end[doc] - length
                follows = np.append(doc[1:] == doc[:-1], False)
                upto = np.minimum(np.where(follows, np.append(a[1:], 0), last + 1), last + 1)
                own = np.maximum(upto - a, 0)  # the windows that start from here up to the next anchor
                j = np.searchsorted(a, upto + length - 1 - k)
                j_ = np.minimum(j, len(a) - 1)
                to = np.where((j < len(a)) & (doc[j_] == doc), np.minimum(a[j_] + k, end), end)
                label, check = seq.label(a, np.where(own > 0, to, a))
                yield pd.DataFrame({"h": kmers[a].view(np.int64), "d": d[part][doc], "t": t[part][doc], "pos": (a - seq.start[doc]).astype(np.int32), "own": own.astype(np.int32), "label": label, "check": check})

    return run


def _open_windows(length: int, k: int):
    """Windows whose k-mer repeats and that no repeated path holds; and, with open false, the windows of the first
    place of each repeated path, for the open ones to be compared with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, d, t, marks = pdf["w"].tolist(), pdf["d"].to_numpy(), pdf["t"].to_numpy(), pdf["marks"].tolist()
            for part in _slices(docs):
                seq = Sequence(docs[part])
                at = seq.windows(length)
                if not len(at):
                    continue
                place, _ = seq.anchors(at, length, k)
                m = np.concatenate(marks[part]).astype(np.int64)
                base = np.repeat(seq.start, [len(x) for x in marks[part]])
                repeats = np.zeros(len(seq.x) + 1, bool)
                repeats[base + (m >> 32)] = True
                lo, own = base + (m >> 32), (m & 0xFFFFFFFF) >> 2
                held, first = (_cover(lo, lo + own, (m & bit) > 0, len(seq.x)) for bit in (1, 2))
                at = at[(repeats[place] & ~held[at]) | first[at]]
                label, check = seq.label(at, at + length)
                doc = seq.doc[at]
                yield pd.DataFrame({"label": label, "check": check, "d": d[part][doc], "t": t[part][doc], "pos": (at - seq.start[doc]).astype(np.int32), "open": ~held[at]})

    return run


def _cover(lo: np.ndarray, hi: np.ndarray, use: np.ndarray, n: int) -> np.ndarray:
    """Which of 0..n-1 lie in some [lo, hi) in use."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo[use], 1)
    np.add.at(edge, np.minimum(hi[use], n), -1)
    return np.cumsum(edge)[:n] > 0


def removed_words(n: int, marks, starts, length: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    m = np.asarray(marks if marks is not None else [], np.int64)
    s = np.asarray(starts if starts is not None else [], np.int64)
    lo, own = m >> 32, (m & 0xFFFFFFFF) >> 2
    use = ((m & 1) == 1) & (own > 0)
    return _cover(np.concatenate([lo, s]), np.concatenate([lo + own + length - 1, s + length]), np.concatenate([use, np.ones(len(s), bool)]), n)


NO_ID = -(1 << 63)


def mark_repeats(docs: DataFrame, length: int = 35, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, text, marks, starts): docs with the repeated windows of each, for removed_words.

    From every window of `length` words the k-mer with the least hash is sampled, so that equal windows sample the same
    place; sampled k-mers are the edges of the graph, about one in 16 words. A k-mer met once rules out all windows that
    sampled it. From each repeated k-mer a path runs on over the following ones until it holds all windows that start
    before the next; paths are labelled by their words (96 bits) and counted, and those met again hold repeated windows
    only. The windows left, at the ends of repeated passages and where copies differ, are compared one by one by their
    own labels, with each other and with those of one place of each repeated path, and all come back to their documents
    by source coordinates. A path or k-mer in a third of all documents
    is one row a task when counted; the join that brings the k-mers' counts back is one that Spark can split, and what is
    counted of the few hottest paths comes back without a shuffle.

    A null text has no words. Equal windows count wherever they start, in the same document too. A row is known by its
    id and a hash of its text; rows that share both are places of their own and get the same marks. A null id reads -2**63
    in d, which no document may have as its id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(body).alias("t"), body.alias("text"))
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")
    paths = rows.select("d", "t", hashed).mapInPandas(_paths(length, k), "h long, d long, t long, pos int, own int, label long, check int")
    again = paths.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    paths = stable(split_join(paths, again, ["h"]).drop("h"))
    on = ["label", "check"]
    counted = lambda some: some.where("own > 0").groupBy(on).agg(F.count("*").alias("n"), F.min(F.xxhash64("d", "t", "pos")).alias("first")).where("n > 1").drop("n")
    hot = F.broadcast(hot_keys(paths, on))
    rest = paths.join(hot, on, "left_anti")
    often = counted(paths.join(hot, on, "left_semi"))
    found = rest.join(counted(rest), on, "left").unionByName(paths.join(hot, on, "left_semi").join(F.broadcast(often), on, "left"))
    held = F.when((F.col("own") > 0) & F.col("first").isNotNull(), F.when(F.xxhash64("d", "t", "pos") == F.col("first"), 3).otherwise(1)).otherwise(0)
    mark = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("own") * 4 + held
    marks = found.select("d", "t", mark.alias("mark")).groupBy("d", "t").agg(F.collect_set("mark").alias("marks"))
    marked = rows.join(marks, ["d", "t"], "left")
    left = marked.where(F.col("marks").isNotNull()).select("d", "t", hashed, "marks")
    left = left.mapInPandas(_open_windows(length, k), "label long, check int, d long, t long, pos int, open boolean")
    same = left.groupBy("label", "check").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    starts = left.where("open").join(same, ["label", "check"]).groupBy("d", "t").agg(F.collect_set("pos").alias("starts"))
    return marked.join(starts, ["d", "t"], "left")


def remove_repeats(docs: DataFrame, length: int = 35, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): the texts without the words of windows of `length` words that start anywhere
    else too, the kept words joined by one space. A null text has no words and comes back empty, repeated rows repeat
    each other's windows, a null id keeps its row; an empty table gives no rows, other columns do not come back."""
    schema = "doc_id long, text string, n_words long, n_removed long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, text_, marks, starts in zip(pdf["d"], pdf["text"], pdf["marks"], pdf["starts"], strict=True):
                w = text_.encode("utf-8", "surrogatepass").split()
                gone = removed_words(len(w), marks, starts, length)
                kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g] if gone.any() else w
                out.append((d, b" ".join(kept).decode("utf-8", "surrogatepass"), len(w), len(w) - len(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_words", "n_removed"])

    found = mark_repeats(docs, length, k, key, text).select("d", "text", "marks", "starts").mapInPandas(run, schema)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM p),
r AS (SELECT doc_id, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t.s, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s FROM k ANTI JOIN g USING (doc_id, j) GROUP BY doc_id) t USING (doc_id)
"""
