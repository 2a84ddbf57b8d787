"""How two tokenizers cut the same texts: groups of tokens that end together, and how widely their links are held."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import shared_folder, slices, split_join, stable, table
from driftline.llm.packing import LONG_GAP, PRINTABLE, encoder, tokenizer_path

#: One blank between characters that are none: neither vocabulary has a token that reaches over it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where there is nothing of this, every blank is such a one.
NOT_ALONE = re.compile(r" \s|\s |^ | $")
#: Units of at most so many characters are encoded together, in strings of about so many.
SHORT, JOINED = 1000, 100_000


@dataclass
class Groups:
    """The groups of a list of units. Group g holds the tokens a[from_a[g]:from_a[g + 1]] and b[from_b[g]:from_b[g + 1]];
    unit u has the groups from start[u] to start[u + 1], or none where its tokens don't give back its bytes."""

    a: np.ndarray
    b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    start: np.ndarray

    @staticmethod
    def together(parts: list[Groups]) -> Groups:
        def joined(name: str) -> np.ndarray:
            each = [getattr(p, name) for p in parts]
            ends = np.cumsum([0, *[x[-1] for x in each]])
            return np.concatenate([[0], *[x[1:] + at for x, at in zip(each, ends, strict=False)]]).astype(np.int64)

        cat = lambda xs: np.concatenate([np.empty(0, np.int64), *xs])
        return Groups(cat([p.a for p in parts]), cat([p.b for p in parts]), joined("from_a"), joined("from_b"), joined("start"))


class Aligner:
    """Groups of blank + text under a byte-level file (A) and a sentencepiece model (B), which adds the blank itself.

    A plain byte-level file parts texts before merging, and a blank goes with what follows it; where no piece of the model
    has a blank behind another character, its merges don't reach over one either. Then the text between two single blanks
    is encoded alike wherever it stands: each such unit is encoded once a block, many of them in one string. Under other
    files a text is one unit.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.fast = encoder(path_a).fast
        self.tokenizer = Tokenizer.from_file(path_a)
        self.tokenizer.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        written = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for w, i in vocab.items():
            self.bytes_a[i] = bytes(written[c] for c in w) if all(c in written for c in w) else b""
        self.model = SentencePieceProcessor(model_file=path_b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.asarray([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.separable = self.fast is not None and not any(re.search("[^▁]▁", p) for p in pieces)

    def units(self, text: str) -> list[str]:
        if not self.separable:
            return [text]
        return CUT.split(text) if NOT_ALONE.search(text) else text.split(" ")

    def encode_a(self, text: str) -> list[int]:
        if self.fast is None or (len(text) > 10_000 and LONG_GAP.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def align(self, units: list[str]) -> Groups:
        """The groups of blank + unit for each unit, which must be able to stand one after the other if there are several.
        A unit whose bytes the tokens don't give back is found by halves."""
        text = " ".join(units)
        a, b, whole = self.fast(" " + text) if len(units) > 1 else self.encode_a(" " + text), self.model.encode(text), (" " + text).encode()
        empty = np.empty(0, np.int64)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole or b"".join([self.bytes_a[i] if i < len(self.bytes_a) else b"" for i in a]) != whole:
            if len(units) == 1:
                return Groups(empty, empty, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(2, np.int64))
            half = len(units) // 2
            return Groups.together([self.align(units[:half]), self.align(units[half:])])
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        both = np.intersect1d(ends_a, ends_b)
        after = lambda ends: np.concatenate([[0], np.searchsorted(ends, both, "right")])
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        start = np.searchsorted(both, ends)
        if start[-1] >= len(both) or (both[start] != ends).any():
            raise RuntimeError("a token reaches over the blank between two units")
        return Groups(a, b, after(ends_a), after(ends_b), np.concatenate([[0], start + 1]))

    def align_all(self, units: list[str]) -> Groups:
        """The groups of all units, in their order."""
        parts, some, size = [], [], 0
        for u in units:
            alone = not self.separable or len(u) > SHORT or u[0].isspace() or u[-1].isspace()
            if some and (alone or size > JOINED):
                parts.append(self.align(some))
                some, size = [], 0
            if alone:
                parts.append(self.align([u]))
            else:
                some.append(u)
                size += len(u) + 1
        return Groups.together([*parts, self.align(some)] if some else parts)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, times binary"
#: Rows of three kinds: a document with the groups it holds, numbered in its block; a group of a block, with the block's
#: documents that hold it; an id pair with what its groups count too often.
ENCODED = f"block long, {DOC}, local int, a array<int>, b array<int>, docs long, x int, y int, excess long"
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("held", pa.binary()), ("times", pa.binary()),
    ("local", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("docs", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("excess", pa.int64())])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _spread(key: np.ndarray, start: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[start[k]:start[k + 1]] of all keys, one after the other, and which key each entry comes from."""
    n = start[key + 1] - start[key]
    which = np.repeat(np.arange(len(key)), n)
    return values[np.repeat(start[key] - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(which) else values[:0], which


class Block:
    """Documents of a task until their texts have some megabytes, with a dictionary of the groups that they hold."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.units: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.held: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str, align: Aligner) -> None:
        at = self.units
        self.ids.append(doc_id)
        self.held.append(np.asarray([at.setdefault(u, len(at)) for u in align.units(text)] if text else [], np.int32))
        self.chars += len(text)

    def rows(self, align: Aligner) -> Iterator[pa.RecordBatch]:
        g, n_docs, n_units = align.align_all(list(self.units)), len(self.ids), len(self.units)
        n_a, n_b = np.diff(g.from_a), np.diff(g.from_b)
        local, of = _interned(g, n_a, n_b)
        said = [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in local]
        # documents with a unit that has no groups have no tokens
        doc, unit = np.repeat(np.arange(n_docs), [len(h) for h in self.held]), np.concatenate([np.empty(0, np.int32), *self.held])
        bad = np.bincount(doc, np.diff(g.start)[unit] == 0, n_docs) > 0
        doc, unit = doc[~bad[doc]], unit[~bad[doc]].astype(np.int64)

        def total(of_group: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(of_group)])
            return np.bincount(doc, (upto[g.start[1:]] - upto[g.start[:-1]])[unit], n_docs).astype(np.int64)

        at = of.tolist()
        of_unit = [";".join([said[k] for k in at[i:j]]) for i, j in zip(g.start.tolist(), g.start[1:].tolist(), strict=False)]
        sha = ["" if b or not len(h) else hashlib.sha256(";".join([of_unit[u] for u in h.tolist()]).encode()).hexdigest() for h, b in zip(self.held, bad, strict=True)]
        del of_unit, said, at
        # how often each document holds each group of the block
        some, times = np.unique(doc * max(1, n_units) + unit, return_counts=True)
        doc_, unit_ = np.divmod(some, max(1, n_units))
        group, which = _spread(unit_, g.start, of)
        key, inverse = np.unique(doc_[which] * max(1, len(local)) + group, return_inverse=True)
        times = np.bincount(inverse, times[which]).astype(np.int64)
        holder, group = np.divmod(key, max(1, len(local)))
        first = np.searchsorted(holder, np.arange(n_docs + 1))
        held, often = group.astype("<u4"), times.astype("<u4")
        yield _rows(
            n_docs, block=np.full(n_docs, self.number), doc_id=self.ids, n_a=total(n_a), n_b=total(n_b), n_groups=total(np.ones(len(n_a), np.int64)), n_links=total(n_a * n_b), groups_sha256=sha,
            held=[_planes(held[i:j]) for i, j in zip(first, first[1:], strict=False)], times=[_planes(often[i:j]) for i, j in zip(first, first[1:], strict=False)],
        )
        if local:
            n = len(local)
            yield _rows(n, block=np.full(n, self.number), local=np.arange(n, dtype=np.int32), a=[a for a, _ in local], b=[b for _, b in local], docs=np.bincount(group, minlength=n))
            yield from self._excess(local, holder, group)

    def _excess(self, local: list[tuple], doc: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs, start = [], [0]
        for a, b in local:
            pairs += [a[0] << 32 | b[0]] if len(a) == len(b) == 1 else [x << 32 | y for x in set(a) for y in set(b)]
            start.append(len(pairs))
        pair, at, groups = np.unique(np.asarray(pairs, np.int64), return_inverse=True, return_counts=True)
        # only pairs of several groups can stand in several groups of a document
        shared = groups[at] > 1
        start = np.concatenate([[0], np.cumsum(shared)])[np.asarray(start)]
        each, which = _spread(group, start, at[shared])
        key, n = np.unique(doc[which] * len(pair) + each, return_counts=True)
        excess = np.bincount(key % len(pair), n - 1, len(pair)).astype(np.int64)
        some = np.flatnonzero(excess)
        if len(some):
            yield _rows(len(some), block=np.full(len(some), self.number), x=(pair[some] >> 32).astype(np.int32), y=(pair[some] & 0xFFFFFFFF).astype(np.int32), excess=excess[some])


def _interned(g: Groups, n_a: np.ndarray, n_b: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The distinct groups, each ((a ids), (b ids)), and the number among them of every group."""
    one = (n_a == 1) & (n_b == 1)
    pair, inverse = np.unique(g.a[g.from_a[:-1][one]] << 32 | g.b[g.from_b[:-1][one]], return_inverse=True)
    local = [((x >> 32,), (x & 0xFFFFFFFF,)) for x in pair.tolist()]
    of = np.empty(len(n_a), np.int64)
    of[one] = inverse
    a, b = g.a.astype("<u4").tobytes(), g.b.astype("<u4").tobytes()
    many = np.flatnonzero(~one)
    known: dict[tuple[bytes, bytes], int] = {}
    bounds = [(4 * x).tolist() for x in (g.from_a[many], g.from_a[many + 1], g.from_b[many], g.from_b[many + 1])]
    of[many] = [known.setdefault((a[i:j], b[k:m]), len(local) + len(known)) for i, j, k, m in zip(*bounds, strict=True)]
    return local + [(tuple(np.frombuffer(x, "<u4").tolist()), tuple(np.frombuffer(y, "<u4").tolist())) for x, y in known], of


def _planes(x: np.ndarray) -> bytes:
    """Four-byte numbers, all first bytes before all second ones and so on, which packs well."""
    return x.view("u1").reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encoded(docs: DataFrame, path_a: str, path_b: str, block_chars: int = 8_000_000) -> DataFrame:
    """The rows ENCODED of docs (doc_id, text), in blocks of about block_chars characters of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(number)
        for part in slices(batches):
            for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                block.add(d, text, align)
                if block.chars >= block_chars:
                    yield from block.rows(align)
                    block = Block(block.number + 1)
        if block.ids:
            yield from block.rows(align)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ENCODED)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group_id, x, y, times, docs): the distinct id pairs of each group and how often it links them."""
    for batch in batches:
        for part in slices([batch], "a", 50_000):
            g, x, y, times, docs = [], [], [], [], []
            for i, a, b, n in zip(*[part.column(c).to_pylist() for c in ("group_id", "a", "b", "docs")], strict=True):
                ids_a, n_a = np.unique(a, return_counts=True)
                ids_b, n_b = np.unique(b, return_counts=True)
                x.append(np.repeat(ids_a, len(ids_b)))
                y.append(np.tile(ids_b, len(ids_a)))
                times.append(np.outer(n_a, n_b).ravel())
                g.append(np.full(len(x[-1]), i))
                docs.append(np.full(len(x[-1]), n))
            cat = lambda parts, kind: pa.array(np.concatenate(parts), kind)
            yield pa.RecordBatch.from_arrays([cat(g, pa.int64()), cat(x, pa.int32()), cat(y, pa.int32()), cat(times, pa.int64()), cat(docs, pa.int64())], ["group_id", "x", "y", "times", "docs"])


def dictionary(rows: DataFrame) -> DataFrame:
    """(group_id, a, b, docs): the distinct groups of all blocks, each with a number and the documents that hold it. Written,
    so that the numbers stay."""
    groups = rows.where("local is not null").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return stable(groups.withColumn("group_id", F.monotonically_increasing_id()))


def pair_counts(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(x, y, count, best): id pairs with the documents that hold them linked, and whether no other pair of their A id has
    more. The documents of a pair's groups are added up; what documents that hold it in several groups count too often,
    the blocks have found."""
    each = links.select("x", "y", F.col("docs").alias("n")).unionByName(rows.where("excess is not null").select("x", "y", (-F.col("excess")).alias("n")))
    pairs = stable(each.groupBy("x", "y").agg(F.sum("n").alias("count")))
    top = pairs.groupBy("x").agg(F.max("count").alias("top"))
    # a row an A id: as many as the vocabulary has
    return pairs.join(F.broadcast(top), "x").select("x", "y", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text).

    Tasks encode texts in blocks and intern the groups of a block, so a document becomes numbers of groups and how often it
    holds each. The dictionary of all blocks gives a group one entry; its links are expanded there, once, and counted by
    the documents that hold it. A group's sums (links that are their A id's most widely held, and all counts) go back to
    the blocks by the group, and to the documents by the block. Only a block's dictionary and its documents' numbers meet
    in a task, and nothing is broadcast but a row an A id.
    A null or empty text and one whose tokens don't give back its bytes have no tokens: zeros and ''. Null and repeated ids
    are rows like any other, and each counts as a document; other columns play no part. No documents give no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    encoded(docs, path_a, path_b, block_chars).write.parquet(path)
    rows = spark.read.schema(ENCODED).parquet(path)
    groups = dictionary(rows)
    links = groups.mapInArrow(_links, "group_id long, x int, y int, times long, docs long")
    counted = split_join(links, pair_counts(links, rows), ["x", "y"])
    sums = counted.groupBy("group_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    of_block = split_join(rows.where("local is not null").select("block", "local", "a", "b"), groups.join(sums, "group_id").select("a", "b", "n_best", "count_sum"), ["a", "b"])

    def summed(held: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("local")
        best, count = values["n_best"].to_numpy(), values["count_sum"].to_numpy()
        of = [(_from_planes(h), _from_planes(t)) for h, t in zip(held["held"], held["times"], strict=True)]
        return held.drop(columns=["block", "held", "times"]).assign(n_best=[int((best[h] * t).sum()) for h, t in of], count_sum=[int((count[h] * t).sum()) for h, t in of])

    documents = spark.read.schema(f"block long, {DOC}").parquet(path).where("n_a is not null")
    out = documents.groupBy("block").cogroup(of_block.select("block", "local", "n_best", "count_sum").groupBy("block"))
    out = stable(out.applyInPandas(summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the byte-level and the sentencepiece vocabulary."""
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
