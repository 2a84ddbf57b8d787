"""What each of several filters removes from a corpus, under every order in which they can be applied."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import let, split_join, stable, table, words

#: More filters have over 5,040 orders a part.
MOST_FILTERS = 7


def trie_edges(rows: DataFrame, names: list[str], marks: list[str]) -> DataFrame:
    """(part, before, name, kept, removed, and lost_MARK for each mark) for every edge of the trie of all orders: what the
    filter `name` removes from the rows that the filters of the bit mask `before` have left.

    rows: part, fails_NAME (boolean) for each name, and the marks (boolean). The trie is walked depth first. A node's
    survivors are persisted while the nodes below them are made from them, so at most one path of the trie is kept at a
    time, and a lost block is filtered again. Orders that begin with the same filters in another turn share a node: of n
    filters, 2 ** n nodes are run instead of n! paths. Every edge counts the rows that really go. Rows with a null part
    count to the part ''. Parts of which nothing is left have no edges; no rows give none.
    """
    done: dict[int, DataFrame | None] = {}

    def visit(applied: int, survivors: DataFrame) -> None:
        left = [i for i in range(len(names)) if not applied >> i & 1]
        if not left:
            done[applied] = None
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        sums = [F.count("*").alias("all")]
        for i in left:
            fails = F.col(f"fails_{names[i]}")
            sums += [F.count_if(fails).alias(f"removed_{i}"), *[F.count_if(fails & F.col(m)).alias(f"lost_{i}_{m}") for m in marks]]
        done[applied] = stable(survivors.groupBy("part").agg(*sums))  # a row a part
        for i in left:
            if applied | 1 << i not in done:
                visit(applied | 1 << i, survivors.where(~F.col(f"fails_{names[i]}")))
        survivors.unpersist()

    visit(0, rows.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit(""))))
    out = None
    for before, counts in done.items():
        if counts is None:
            continue
        edge = lambda i: F.struct(
            F.lit(before).alias("before"), F.lit(names[i]).alias("name"), (F.col("all") - F.col(f"removed_{i}")).alias("kept"), F.col(f"removed_{i}").alias("removed"), *[F.col(f"lost_{i}_{m}").alias(f"lost_{m}") for m in marks]
        )
        each = counts.select("part", F.explode(F.array(*[edge(i) for i in range(len(names)) if not before >> i & 1])).alias("x")).select("part", "x.*")
        out = each if out is None else out.unionByName(each)
    return out


def order_report(edges: DataFrame, names: list[str], marks: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, MARK_lost for each mark, shapley): each part under
    each order of the filters, a row a step, zeros included.

    redundant: rows of the part that fail the step's filter and went earlier; unique_fails: those that fail this filter
    only; shapley: what the filter removes, summed over all orders. edges: as trie_edges gives them, 80 a part for five
    filters; a part stands in the report if it has any.
    """
    n, last = len(names), (1 << len(names)) - 1
    spark = edges.sparkSession
    # edges without rows: a part that is used up has no counts there
    blank = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(names[i]).alias("name")) for b in range(last) for i in range(n) if not b >> i & 1])
    zero = edges.select("part").distinct().select("part", F.explode(blank).alias("x")).select("part", "x.*", *[F.lit(0).cast("long").alias(c) for c in ("kept", "removed", *[f"lost_{m}" for m in marks])])
    full = edges.unionByName(zero).groupBy("part", "before", "name").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", *[f"lost_{m}" for m in marks])])
    # so many orders pass an edge
    passed = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)])
    of_filter = Window.partitionBy("part", "name")
    alone = F.bit_count("before") == n - 1
    full = full.withColumns({
        "fails": F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(of_filter), "unique_fails": F.sum(F.when(alone, F.col("removed"))).over(of_filter),
        "shapley": F.sum(F.col("removed") * F.get(passed, F.bit_count("before"))).over(of_filter)})
    bit = {x: 1 << i for i, x in enumerate(names)}
    steps = [("".join(order), k + 1, sum(bit[x] for x in order[:k]), order[k]) for order in itertools.permutations(names) for k in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, name string")  # n * n! rows, by the bound on n
    out = full.join(F.broadcast(orders), ["before", "name"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[F.col(f"lost_{m}").alias(f"{m}_lost") for m in marks], "shapley")


def audit(rows: DataFrame, names: Iterable[str], marks: Iterable[str] = ()) -> DataFrame:
    """order_report of rows (part, fails_NAME, marks): how filters overlap and what each order of them would cost.

    Null conditions count as not failing, null marks as not set; a null part is ''; repeated rows count each; other columns
    play no part. No rows give no report. At most MOST_FILTERS names of one character each.
    """
    names, marks = list(names), list(marks)
    if len(names) > MOST_FILTERS or len(set(names)) < len(names) or any(len(x) != 1 for x in names):
        raise ValueError(f"at most {MOST_FILTERS} filters with different names of one character")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    kept = stable(rows.select("part", *[flag(f"fails_{x}") for x in names], *[flag(m) for m in marks]))
    return order_report(trie_edges(kept, names, marks), names, marks)


def corpus_conditions(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, fails_A .. fails_E) of whole texts: A, under 100 words; B, under 80 distinct words of 100; C, over 10
    capitals of 100 characters; D, one of #$%&*|; E, the same text as a row with a smaller key.

    A null text is an empty one. A row with a null key doesn't fail E and makes no other row fail it; rows that share key
    and text don't make each other fail. Texts are read once: lengths and digests are written, and the first key of each
    text that stands under several keys comes back by a join that Spark can split, however many rows share a text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = let(words(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), size.alias("w"), (100 * capitals > 10 * F.length(t)).alias("fails_C"), t.rlike("[#$%&*|]").alias("fails_D"), F.unhex(F.sha2(t, 256)).alias("digest"))
    rows = stable(rows.select("key", "part", (F.col("w.n") < 100).alias("fails_A"), (100 * F.col("w.distinct") < 80 * F.col("w.n")).alias("fails_B"), "fails_C", "fails_D", "digest"))
    first = rows.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").drop("last")
    return split_join(rows, first, ["digest"], "left").withColumn("fails_E", F.coalesce(F.col("key") > F.col("first"), F.lit(False))).drop("digest", "first")


FILTERS = "ABCDE"


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents by language, with the good and the toxic documents that they cost. Of
    several labels of a document any counts."""
    rows = corpus_conditions(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    labels = table(spark, sf_dir, "labels").where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("key"))
    marked = split_join(rows, labels.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")), ["key"], "left")
    return audit(marked, FILTERS, ("good", "toxic"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 10 * length(d.text))::INT
    + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > s.first, false)::INT AS m
  FROM d JOIN s ON s.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
p AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 4, 8, 16]) AS b, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a JOIN x b ON b.b <> a.b JOIN x c ON c.b NOT IN (a.b, b.b)
  JOIN x d ON d.b NOT IN (a.b, b.b, c.b) JOIN x e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
t AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
e AS (SELECT part, bit, before, sum(n) FILTER (m & before = 0 AND m & bit = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & bit <> 0) AS removed,
    sum(n) FILTER (m & before <> 0 AND m & bit <> 0) AS redundant, sum(n) FILTER (m = bit) AS alone,
    sum(good) FILTER (m & before = 0 AND m & bit <> 0) AS good, sum(toxic) FILTER (m & before = 0 AND m & bit <> 0) AS toxic
  FROM p, (SELECT DISTINCT bit, before FROM t) GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(alone, 0)::BIGINT AS unique_fails, coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost FROM t JOIN e USING (bit, before))
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
