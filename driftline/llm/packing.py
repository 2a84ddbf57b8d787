"""Packing tokenised documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import pieces_of, slices, stable, table

_ENCODERS: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level tokenizer files write bytes that are no printable characters, and the pattern that parts texts before
#: merging; fixed values of that format.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The pattern steps back over a gap, which the regular expressions' stack bounds.
LONG_GAP = re.compile(r"\s{10000}")


class Encoder:
    """Token ids of texts, as `tokenizers` gives them for the file at path with add_special_tokens=False.

    A plain byte-level file whose ids follow the order of its merges needs no more than its vocabulary and the pattern:
    then tiktoken runs the same merges, at half the CPU and without a memory of words. Texts that hold an added token or
    a very long gap, and all texts under any other file, go through `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [x["content"] for x in said.get("added_tokens") or []]
        self.fast = self.merging(said)

    @staticmethod
    def merging(said: dict):
        """The encoder of plain text with the file's merges; None if the file has anything beside them."""
        model, before = said["model"], said.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        alone = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
        if not (plain and alone):
            return None
        rest = [b for b in range(256) if b not in PRINTABLE]
        written = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}
        ids = {bytes(written[c] for c in w): i for w, i in model["vocab"].items() if all(c in written for c in w)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if len(ids) < len(model["vocab"]) or [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or len(ids) != 256 + len(merges):
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added) or (len(text) > 100_000 and LONG_GAP.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each run of at most `window` ids of each document (doc_id, text); its last id is end_id. With with_ids,
    the column ids holds them."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for part in slices(batches):
            rows = []
            for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = array("I", enc.encode(text)).tobytes() + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    rows.append((d, at, len(piece) // 4, zlib.crc32(piece), n, *([np.frombuffer(piece, "<u4").astype("int64")] if with_ids else [])))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def sum_of_squares(lengths: list[int], window: int = 2048) -> tuple[list[int], list[int]]:
    """The bin and the offset of each item, placed in turn into the fill level that leaves the least sum of squared
    counts of partly filled bins; among equals the fullest."""
    count = np.zeros(window + 1, np.int64)  # open bins by fill; 0 and window stay 0
    bins: list[list[int]] = [[] for _ in range(window + 1)]
    n, where, offset = 0, [], []
    far = np.int64(1) << 40
    for s in lengths:
        if s >= window:
            where.append(n)
            offset.append(0)
            n += 1
            continue
        open_ = count[: window - s + 1]
        # by fill h: count[h + s] grows by one, count[h] falls by one
        change = 2 * (count[s:] - open_) + 2
        change[-1] -= 1 + 2 * count[window]  # a full bin no longer counts
        change[open_ == 0] = far
        change[0] = 2 * count[s] + 1
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            b = bins[h].pop()
            count[h] -= 1
        else:
            b = n
            n += 1
        if h + s < window:
            bins[h + s].append(b)
            count[h + s] += 1
        where.append(b)
        offset.append(h)
    return where, offset


def pack(pieces: DataFrame, window: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset: each lies at its offset in one window; no two overlap, fill starts at 0.

    Pieces are packed in groups of about group_rows by a hash of their document, so the work is spread and the level
    array of each group settles; within a group the longest come first, which leaves the least open at its end.
    """
    groups = pieces_of(pieces.count(), group_rows)
    schema = ", ".join(f"{k} {v}" for k, v in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, offset = sum_of_squares(pdf["length"].tolist(), window)
        return pdf.drop(columns="g").assign(sequence_id=np.asarray(where, np.int64) * groups + key[0], offset=np.asarray(offset, np.int64))

    return pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))).groupBy("g").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None, group_rows: int = 20_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every id of every text in exactly one piece.

    Full windows of a document stand alone, the rest of it is packed. A null or empty text has its end id only; rows
    with a null or repeated id are packed like any other; no documents give no rows. Other columns play no part.
    """
    return pack(stable(token_pieces(docs, path or tokenizer_path(), window, end_id)), window, group_rows)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
