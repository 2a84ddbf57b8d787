"""Personal data: the rules against plain regular expressions, and what labelers and classifier add."""

import hashlib
import random
import re

import numpy as np
import pytest

from driftline.llm import pii, registry


def plain(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


@pytest.mark.parametrize("alphabet", ["a@.-_ é", "0125. ", "12 -\x1f!", "+1 ().-x", "a1@.+ -()0259"])
def test_rules_as_plain(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("mail é.a@b.c.d@e.f +1 (234) 555-1234, 4111 1111 1111 1111 1.2.3.4.5.6.7.256") == plain("mail é.a@b.c.d@e.f +1 (234) 555-1234, 4111 1111 1111 1111 1.2.3.4.5.6.7.256")


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+" * 300_000, "+1 " * 100_000, "a@" * 150_000, "1-" * 200_000, " at " * 100_000, "(555) " * 60_000):
        pii.candidates(text)


def test_estimate_finds_the_labelers_that_err():
    rng = np.random.default_rng(1)
    real = rng.random(20_000) < 0.7
    right = np.asarray([0.98, 0.9, 0.8, 0.75, 0.7, 0.55, 0.85])
    cast = rng.random((len(real), 7)) < 0.8
    v = np.where(cast, np.where((rng.random((len(real), 7)) < right) == real[:, None], 1, -1), 0)
    found, n = np.unique(v, axis=0, return_counts=True)
    r = pii.estimate(found, n.astype(float))
    assert abs(r.prior - 0.7) < 0.02
    got = r.chance[1, :, 2] / (r.chance[1, :, 2] + r.chance[1, :, 0])
    assert np.abs(got - right).max() < 0.03
    assert ((r.posterior(v) > 0.5) == real).mean() > 0.97
    code = [pii.vote_code(tuple(x)) for x in found.tolist()]
    assert (pii.votes_of(np.asarray(code)) == found).all()


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta house river mountain when where other some text".split())
    real = [lambda: f"{word()}.{rng.randrange(90)}@mail{rng.randrange(9)}.example.com", lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: ".".join(str(rng.randrange(11, 220)) for _ in range(4))]
    other = [lambda: f"{word()} {rng.choice(['(at)', '[at]'])} mail.example.com", lambda: f"call ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    decoy = [lambda: f"order {rng.randrange(100, 199)}{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}x", lambda: f"token=\"{rng.randrange(10**15, 10**16)}a\""]
    rows = []
    for i in range(400):
        w = [word() for _ in range(60)]
        kind = i % 5
        planted = rng.choice(real)() if kind < 2 else rng.choice(other)() if kind == 2 else rng.choice(decoy)() if kind == 3 else ""
        rows.append((i, " ".join(w[:30]) + " " + planted + " " + " ".join(w[30:]), kind, planted))
    return rows


SCHEMA = "doc_id long, text string, kind int, found string"


def test_added_spans(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = pii.find_candidates(df)
    model = pii.fit(found)
    got = {r["doc_id"]: r for r in pii.spans_of(found, model).collect()}
    for kind, least, most in ((0, 1, 1), (1, 1, 1), (2, 0.9, 1), (3, 0, 0.05), (4, 0, 0)):
        mine = [got[r[0]] for r in rows if r[2] == kind]
        assert least <= sum(bool(r["spans"]) for r in mine) / len(mine) <= most, kind
    for d, text, *_ in rows:
        base = plain(text)
        assert got[d]["base_sha256"] == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert set(filter(None, pii.said(base).split(","))) <= set(got[d]["spans"].split(","))
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert all(out[d].count("[") == (1 if got[d]["spans"] else text.count("[")) or "[at]" in text for d, text, *_ in rows)
    assert all(planted not in out[d] for d, _, kind, planted in rows if kind < 2)
    again = pii.fit(found.repartition(7))
    assert np.array_equal(again.weights, model.weights)


def test_odd_rows(spark):
    rows = [(None, None, 1, "x"), (None, "", 1, "x"), (1, "a@b.cd", 1, None), (1, "a@b.cd", 1, None), (2, "x" * 100_000 + " a@b.cd", 2, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = pii.find_candidates(df)
    out = pii.spans_of(found, pii.fit(found))
    assert sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in out.collect()) == [("1", 1, "email:0:6"), ("1", 1, "email:0:6"), ("2", 1, "email:100001:100007"), ("None", 0, ""), ("None", 0, "")]
    assert [r["text"] for r in pii.redact(df, pii.fit(found)).collect()][:3] == [None, "", "[email]"]
    none = pii.find_candidates(df.limit(0))
    assert pii.spans_of(none, pii.fit(none)).count() == 0


def test_op11(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = registry.queries()["op11_personal_data"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        base = plain(docs[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert set(filter(None, pii.said(base).split(","))) <= set(r["spans"].split(",")) and r["n_added"] >= 0
