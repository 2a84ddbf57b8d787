"""The filter audit against a plain run of every order, on small tables with nulls, empty texts, ties and repeats."""

import itertools
import random
import re

import pytest

from driftline.llm import filter_audit, registry

DOCS, LABELS = "doc_id long, text string, lang string, key long, part int, fails_A string", "doc_id long, quality int, toxic int"


def corpus(n):
    rng = random.Random(n)
    pool = [None, "", "short", "word " * 120, " ".join(f"w{i}" for i in range(130)), "LOUD " + " ".join(f"w{i}" for i in range(130)), "SHOUT " * 100, "a # b", "é " + "$ " * 110, "\x85".join("ab" for _ in range(120))]
    ids = lambda i: None if i % 17 == 5 else i // (1 + (i % 11 == 3))
    rows = [(ids(i), rng.choice(pool) if i % 3 else " ".join(rng.choice(["X", "y", "z%", f"u{i}"]) for _ in range(rng.randrange(220))), rng.choice(["en", "de", None, ""]), 1, 2, "x") for i in range(n)]
    labels = [(rng.choice([None, *range(n)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return rows, labels


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, part, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        docs.append((part or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, sums = [], {}
    for part in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                fails = sum(f in x[1] for x in mine)
                out.append([part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)])
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("n", [0, 60])
def test_audit(spark, tmp_path, n):
    rows, labels = corpus(n)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["op13_filter_audit"](spark, str(tmp_path))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == plain(rows, labels)


def test_other_filters(spark):
    """Two filters of one's own; null conditions and extra columns."""
    rows = spark.createDataFrame([("a", True, None, 1), ("a", True, True, 2), (None, None, True, 3)], "part string, fails_X boolean, fails_Y boolean, n int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(rows, "XY").collect()}
    assert got["a", "XY", 1] == (0, 2, 0, 1, 3) and got["a", "XY", 2] == (0, 0, 1, 0, 1) and got["a", "YX", 1] == (1, 1, 0, 0, 1) and got["", "YX", 1] == (0, 1, 0, 1, 2)
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "XX")
