"""Queries as registered: on the small tables against plain versions, on empty tables and on one with odd rows."""

import collections
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from test_llm import LOWER, SCHEMA, corpus, words

from driftline.llm import quality, registry, vector_dedup
from driftline.llm.packing import tokenizer_path

#: op4, op12 and op13 have such tests of their own, op5 reads another table.
ON_DOCUMENTS = [q for q in registry.queries() if q.startswith("op") and q.split("_")[0] not in ("op4", "op5", "op12", "op13")]


@pytest.fixture(scope="module")
def small(spark, sf):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = {k: str(tmp_path_factory.mktemp(k)) for k in ("empty", "odd")}
    docs = spark.createDataFrame(corpus(), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for k, n in (("empty", 0), ("odd", 1000)):
        docs.limit(n).write.parquet(f"{at[k]}/documents.parquet")
        labels.limit(n).write.parquet(f"{at[k]}/labels.parquet")
    return at


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_no_rows_and_odd_rows(spark, folders, name):
    """Nothing comes of nothing; of odd rows each comes back, as often as it is there."""
    query = registry.queries()[name]
    assert query(spark, folders["empty"]).count() == 0
    out = query(spark, folders["odd"])
    rows = out.where("start = 0") if name.startswith("op10") else out
    assert collections.Counter(r["doc_id"] for r in rows.select("doc_id").collect()) == collections.Counter(r[0] for r in corpus())


def test_op6(spark, sf, small):
    def fp(text):
        w = words(text.translate(LOWER))
        h = np.asarray([xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))], np.uint64) if w else np.zeros(0, np.uint64)
        return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))

    prints = {d: fp(t) for d, t, _ in small}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.queries()["op6_simhash_near_dedup"](spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in prints}


def test_op7(spark, sf, small):
    """Scores are those of the fitted dictionaries and curve, recomputed block by block."""
    out = {r["doc_id"]: r for r in registry.queries()["op7_quality_classifier"](spark, sf).collect()}
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ~quality.held_out(F.col("doc_id")))
    size = lambda data, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    for d, text, _ in small:
        data = text.encode()
        saved = sum(size(data[i : i + 512], model.bad) - size(data[i : i + 512], model.good) for i in range(0, len(data), 512))
        want = 1 / (1 + np.exp(-(model.slope * (saved / len(data) if data else 0.0) + model.intercept)))
        assert out[d]["score"] == pytest.approx(want) and out[d]["predicted"] == (out[d]["score"] >= 0.7) and out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_op9(spark, sf, small):
    a, b = ({r["doc_id"]: r for r in registry.queries()["op9_mixing"](spark, sf).collect()} for _ in range(2))
    assert a == b and len(a) == len(small)
    size, source = {d: len(words(t)) for d, t, _ in small}, {d: s for d, _, s in small}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    whole = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, dict.fromkeys(names, 0.0), 1.5 * sum(whole.values())
    free = list(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * whole[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * whole[s]
            left -= target[s]
            free.remove(s)
    for d, r in a.items():
        assert r["size"] == size[d] and r["source_size"] == whole[source[d]] and r["target"] == pytest.approx(target[source[d]]) and 0 <= r["taken"] <= 2 * size[d]
    for s in names:
        taken = sum(r["taken"] for d, r in a.items() if source[d] == s)
        assert abs(taken - target[s]) <= max(0.02 * target[s], 128)


def test_op10(spark, sf, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(text, add_special_tokens=False).ids, 1] for d, text, _ in small}
    rows = registry.queries()["op10_packing"](spark, sf).collect()
    seen, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.asarray(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, most in ((seen, None), (fill, 2048)):
        for k, x in parts.items():
            at = 0
            for start, n in sorted(x):
                assert start == at
                at += n
            assert at == len(ids[k]) if most is None else at <= most
    assert set(seen) == set(ids) and sum(map(len, ids.values())) / (2048 * len(fill)) > 0.9


def test_pipeline_of_no_rows_and_odd_rows(spark, folders, tmp_path):
    """Stages make nothing of nothing; of odd rows with clashing columns they lose no id, null ones included, but those
    that they reject, merge or leave out of the mix."""
    import corpus_pipeline as cp

    odd = spark.read.parquet(f"{folders['odd']}/documents.parquet").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folders['empty']}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    clash = odd.withColumns({c: F.lit("x") for c in ("row", "size", "spans", "epoch", "_d", "_t", "_hash", "d", "t", "root", "copies")})
    ids = lambda df: collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())
    all_ids = ids(odd)
    for name, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), folders["empty"]).count() == 0, name
        out = stage(spark, clash, folders["odd"])
        if name == "packing":
            assert ids(out.where("start = 0")) == all_ids
            continue
        assert out.columns == list(cp.COLUMNS), name
        got = ids(out)
        if name.startswith("line"):
            assert got == all_ids
        elif name.startswith("simhash"):
            assert got <= all_ids and out.where("text is null").count() <= 1
        else:
            assert set(got) <= set(all_ids), name
    mixed = cp.mixing_stage(spark, clash, folders["odd"])
    total = sum(len(words(r["text"] or "")) for r in odd.collect())
    assert sum(len(words(r["text"])) for r in mixed.collect()) == pytest.approx(1.5 * total, rel=0.02, abs=128)


def test_op5_probes_part_by_part(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vector_dedup.fit(x, 500, 0.9, 20, 4, 16, 0.5)
    whole = index.probes(x)
    monkeypatch.setattr(vector_dedup, "CELLS", 70)
    parts = index.probes(x)
    assert len(whole[1]) and all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert all(len(a) == 0 for a in index.probes(x[:0]))
