"""Language-model scores of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import gru
from driftline.llm.common import id_crc, slices, stable, table

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kinds of words without outputs of their own: by the last character, by size, by whether all are single bytes.
KINDS = 12


def kind(w: bytes) -> int:
    last = w[-1:]
    return (1 if last in b".," else 2 if last in PUNCTUATION.encode() else 0) + 3 * (len(w) > 8) + 6 * (not w.isascii())


def kind_column(w: Column) -> Column:
    last = F.substring(w, -1, 1)
    ends = F.when(last.isin(".", ","), 1).when(last.isin(*PUNCTUATION), 2).otherwise(0)
    return ends + F.when(F.octet_length(w) > 8, 3).otherwise(0) + F.when(F.octet_length(w) != F.length(w), 6).otherwise(0)


@dataclass
class Vocabulary:
    """words: frequent words with their training counts, at most as many as asked for; the first `own` of them have
    outputs of their own, as has the end of a text, id 0. kinds: by kind, training tokens and distinct training words
    without an output of their own."""

    words: list[bytes]
    counts: list[int]
    own: int
    ends: int
    total: int
    distinct: int
    kinds: list[tuple[int, int]]

    @property
    def shape(self) -> gru.Shape:
        return gru.Shape(self.own + 1, KINDS)

    def starting_counts(self) -> np.ndarray:
        return np.asarray([self.ends, *self.counts[: self.own], *[n + 1 for n, _ in self.kinds]])


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): the count of every word of the training texts. Null and empty texts have none, repeated rows count as
    often, no rows give none; only the text's column is read. A slice of texts is split and counted in Arrow first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=16_000_000):
            found = split(part.column("text"))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    each = train.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    return stable(each.groupBy("word").agg(F.sum("n").alias("c")))


def vocabulary(counted: DataFrame, ends: int, own: int, known: int, longest: int = 64) -> Vocabulary:
    """Only the most frequent words of at most `longest` bytes, `known` or as many fewer as share the last count, and
    sums come to the driver."""
    short = counted.where(F.octet_length("word") <= longest)
    # words by size of their count, in steps of about 0.07 %: at most a row for each step comes here
    step = F.floor(F.log2(F.col("c").cast("double")) * 1024).alias("step")
    sizes = sorted(((r["step"], r["n"]) for r in short.groupBy(step).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = 1 << 30, known
    for at, many in sizes:
        if many > room:
            break
        least, room = at, room - many
    top = sorted(short.where(step >= least).collect(), key=lambda r: (-r["c"], r["word"]))
    n, v = [x or 0 for x in counted.agg(F.sum("c"), F.count("*")).first()]
    sums = {r["k"]: [r["n"], r["v"]] for r in counted.groupBy(kind_column(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    words_, counts = [r["word"].encode() for r in top], [r["c"] for r in top]
    for w, c in zip(words_[:own], counts[:own], strict=False):
        sums[kind(w)][0] -= c
        sums[kind(w)][1] -= 1
    return Vocabulary(words_, counts, min(own, len(words_)), ends, n + ends, v + (ends > 0), [tuple(sums.get(k, (0, 0))) for k in range(KINDS)])


@dataclass
class Read:
    """The words of some texts, one text after another. starts: where each text's words begin, and their number; ranks:
    1.. for frequent words, else 0; ids: model ids of the words; rare: for each text its other words in a string."""

    starts: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray
    rare: pa.Array

    def documents(self) -> list[np.ndarray]:
        """Each text's model ids, its end included."""
        n = np.diff(self.starts)
        out = np.zeros(len(self.ids) + len(n), np.int64)
        out[np.arange(len(self.ids)) + np.repeat(np.arange(len(n)), n)] = self.ids
        return np.split(out, (self.starts[1:] + np.arange(1, len(n) + 1))[:-1]) if len(n) else []

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        n = np.diff(self.starts)
        return np.bincount(np.repeat(np.arange(len(n)), n), of_words, len(n))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts with A-Z in lower case, and where each text's begin, and their number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    some = pc.binary_length(flat).to_numpy() > 0
    if not some.all():  # around spaces at a text's ends, or for a text without words
        flat, starts = flat.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[starts]
    return flat, starts


def kinds(w: pa.Array) -> np.ndarray:
    """The kind of each word."""
    if not len(w):
        return np.zeros(0, np.int64)
    w = w.cast(pa.large_binary())
    ends = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
    data = np.frombuffer(w.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    wide = np.concatenate([[0], np.cumsum(data > 127)])[ends]
    return _LAST[data[ends[1:] - 1]] + 3 * (np.diff(ends) > 8) + 6 * (np.diff(wide) > 0)


#: By a word's last byte.
_LAST = np.asarray([kind(bytes([b])) % 3 for b in range(256)])


class Reader:
    """Texts as model ids, and where the words' ranks are."""

    def __init__(self, vocab: Vocabulary):
        self.words, self.own = pa.array(vocab.words, pa.binary()).view(pa.string()), vocab.own
        # by rank: a word's own id, or that of its kind
        self.by_rank = np.concatenate([np.arange(vocab.own + 1), vocab.own + 1 + kinds(self.words[vocab.own :])])

    def read(self, texts: pa.Array) -> Read:
        flat, starts = split(texts)
        found = pc.index_in(flat, value_set=self.words.cast(flat.type))
        ranks = pc.fill_null(found, -1).to_numpy().astype(np.int64) + 1
        ids = self.by_rank[ranks]
        other = ranks == 0
        rare = flat.filter(pa.array(other))
        ids[other] = self.own + 1 + kinds(rare)
        begin = np.concatenate([[0], np.cumsum(other)])[starts]
        return Read(starts, ranks, ids, pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), rare), " "))


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = 3, warm_docs: int = 400, rate: float = 0.004, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Weights learnt in one pass over all docs.

    First one task learns from about warm_docs documents. Then all documents are dealt into rounds; in each round
    every task learns from its own documents, starting from the common weights, and the tasks' weights are averaged by
    the tokens they saw: summed in a few tasks, then on the driver, so that the driver holds a few copies however many
    tasks there are.

    A null text is an empty one, of which only the end is learnt; null and repeated ids and rows are learnt from as often
    as they are there. Without training words the weights stay as they start. Other columns play no part.
    """
    spark = docs.sparkSession
    shape = vocab.shape
    weights = gru.flat(gru.start(shape, vocab.starting_counts()))
    if not vocab.total:
        return weights
    source = docs.select(F.col(key).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocab_ = spark.sparkContext.broadcast(vocab)

    def learn(weights_, rate_: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, n = Reader(vocab_.value), 0
            trainer = gru.Trainer(gru.shaped(weights_.value, shape), shape, rate_)
            for part in slices(batches, most=2_000_000):
                ids = reader.read(part.column("text")).documents()
                n += sum(map(len, ids))
                trainer.run(ids, 0)
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "w": [gru.flat(trainer.p).astype("<f4").tobytes()]})

        return run

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0.0
        for pdf in batches:
            for k, w in zip(pdf["n"], pdf["w"], strict=True):
                n += k
                total = total + k * np.frombuffer(w, "<f4").astype(np.float64)
        if n:
            yield pd.DataFrame({"n": [n], "w": [(total / n).astype("<f4").tobytes()]})

    def averaged(part: DataFrame, rate_: float) -> np.ndarray:
        weights_ = spark.sparkContext.broadcast(weights)
        found = part.select("text").mapInArrow(learn(weights_, rate_), "n long, w binary").repartition(8).mapInPandas(summed, "n long, w binary").collect()
        total = sum(r["n"] for r in found)
        return sum(r["n"] / total * np.frombuffer(r["w"], "<f4").astype(np.float64) for r in found).astype(np.float32) if found else weights

    some = min(1.0, warm_docs / max(1, vocab.ends))
    weights = averaged(source.where(place() < some).repartition(1), rate)
    for r, part in enumerate(dealt(source, rounds)):
        weights = averaged(part, rate / (r + 1))
    return weights


def place() -> Column:
    """A document's place from 0 to 1, by a hash of its id and text; a null id has a place too, repeated rows have one
    place."""
    return F.pmod(F.xxhash64("d", F.xxhash64("text")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def dealt(source: DataFrame, rounds: int) -> list[DataFrame]:
    """All documents (d, text), each in one of the rounds."""
    return [source.where(F.floor(place() * rounds) == r) for r in range(rounds)]


def score(docs: DataFrame, vocab: Vocabulary, counted: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row, both scores log10.

    A token's probability is that of its class by the state, times that in its class: by the state for words with
    outputs of their own, by training counts plus one for the others of its kind, all unseen ones together counting as
    one. Counts of frequent words are looked up in the task; the other words come back from it, one after another in a
    string, and are joined with the counts of all training words. A null text is an empty one and has its end only. Rows keep their multiplicity.
    """
    spark = docs.sparkSession
    both = spark.sparkContext.broadcast((vocab, weights))
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(body).alias("t"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = both.value
        reader, p = Reader(vocab), gru.shaped(weights, vocab.shape)
        logs = np.log10(np.asarray([vocab.ends, *vocab.counts], np.float64) + 1)  # by rank, the end first
        end, logs[0] = logs[0], 0
        all_ = np.log10(vocab.total + vocab.distinct + 1)
        of_kind = np.concatenate([np.zeros(vocab.own + 1), np.log10([n + v + 1 for n, v in vocab.kinds])])  # by id
        in_kind = np.where(np.arange(len(logs)) > vocab.own, logs, 0)  # by rank
        for part in slices(batches, most=16_000_000):
            x = reader.read(part.column("text"))
            n = np.diff(x.starts) + 1
            known = x.sums(x.ranks > 0).astype(np.int64) + (vocab.ends > 0)
            base = x.sums(logs[x.ranks]) + end - all_ * n
            lm = gru.score(p, vocab.shape, x.documents(), 0) / np.log(10) + x.sums(in_kind[x.ranks] - of_kind[x.ids])
            columns = [part.column("d"), part.column("t"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(lm), x.rare.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "t", "n_tokens", "n_known", "base", "lm", "rare"])

    read = stable(source.mapInArrow(run, "d long, t long, n_tokens long, n_known long, base double, lm double, rare string"))
    scored = read.groupBy("d", "t").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "lm")])
    rare = read.where("rare <> ''").select("d", "t", F.explode(F.split("rare", " ")).alias("word"))
    rare = rare.join(counted, "word").groupBy("d", "t").agg(F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("logs"), F.count("*").alias("n"))
    out = scored.join(rare.withColumnsRenamed({"d": "_d", "t": "_t"}), F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    more, n = F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0)), F.coalesce((F.col("n") / F.col("copies")).cast("long"), F.lit(0))
    out = out.select(F.col("d").alias("doc_id"), "n_tokens", (F.col("n_known") + n).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("lm") + more).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.drop("copy")


FOLDS, HELD = 7, 2


def op2_language_model(spark: SparkSession, sf_dir: str, own: int = 4096, known: int = 65_536) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_crc(F.col("doc_id")) % FOLDS == HELD
    learnt = docs.where(~held)
    counted = count_words(learnt)
    vocab = vocabulary(counted, learnt.count(), own, known)
    scored = score(docs, vocab, counted, train(learnt, vocab))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
