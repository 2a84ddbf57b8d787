"""Two tokenizers' groups and links against a plain version that encodes whole texts with the libraries."""

import collections
import hashlib
import json
import random

import pytest

from driftline.llm import alignment, registry
from driftline.llm.packing import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = SentencePieceProcessor(model_file=B)
    names = {i: w for w, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    byte = {}
    for i in range(256):  # how the file writes each byte: two-byte characters and plain ones between them show all
        byte.setdefault(chr(i) if 33 <= i < 127 or 161 <= i < 173 or i >= 174 else None, i)
    rest = [i for i in range(256) if not (33 <= i < 127 or 161 <= i < 173 or i >= 174)]
    byte |= {chr(256 + k): i for k, i in enumerate(rest)}
    assert decoders.ByteLevel().decode([names[t.encode(" é").ids[0]]])
    bytes_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
    found, holders = [], collections.defaultdict(set)
    for k, (_, text) in enumerate(rows):
        groups = []
        if text:
            whole = (" " + text).encode()
            a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
            xa, xb = [bytes(byte[c] for c in names[i]) for i in a], [bytes_b[i] for i in b]
            if b"".join(xa) == whole and b"".join(xb) == whole:
                ends = lambda x: {sum(map(len, x[: i + 1])): i + 1 for i in range(len(x))} if len(x) < 500 else dict(zip(__import__("itertools").accumulate(map(len, x)), range(1, len(x) + 1), strict=True))
                ea, eb, i, j = ends(xa), ends(xb), 0, 0
                for at in sorted(ea.keys() & eb.keys()):
                    groups.append((a[i : ea[at]], b[j : eb[at]]))
                    i, j = ea[at], eb[at]
        found.append(groups)
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    holders[x, y].add(k)
    top = collections.Counter()
    for (x, _), h in holders.items():
        top[x] = max(top[x], len(h))
    out = []
    for (d, _), groups in zip(rows, found, strict=True):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((str(d), sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(len(holders[p]) == top[p[0]] for p in links), sum(len(holders[p]) for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out)


def got(df):
    assert df.columns[0] == "doc_id"
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "x\n y\n\n z \t", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ a ▁", "a▁b c", "x ▁y", "\0 \x1c a\x1c b", "  a   b  c", "日本語のテキスト 한국어 नमस्ते", "👩‍👩‍👧 é é ﬁ ①", "don't I'LL 've 's", "aaaa" * 900,
    "antidisestablishmentarianism " * 40, "word123 456.78 1,000,000 %%% ### a.b@c.de", "é" * 3000 + " end", " " * 12_000 + "x", "x" + "\n" * 50 + " y", "la LA La lA", "﻿bom ​zero"]


def test_aligned_as_plain(spark, sf):
    rng = random.Random(3)
    chars = "ab cd eé ’ \n\t 日▁<|>1.,  "
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1000 + i, "".join(rng.choice(chars) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()] + [(None, "said twice"), (7, "said twice"), (7, "said twice")]
    want = plain(rows)
    df = spark.createDataFrame([(*r, 1, [2], 3, "x") for r in rows], "doc_id long, text string, block int, a array<int>, n_best int, held string").repartition(3)
    assert got(alignment.align_documents(df, A, B)) == want
    assert got(alignment.align_documents(df, A, B, block_chars=3000)) == want
    assert got(alignment.align_documents(df.limit(0), A, B)) == []


def test_whole_texts_where_units_are_not_safe():
    one = alignment.Aligner(A, B)
    assert one.separable
    text = "these words and  those"
    cut, parts = one.align_all(one.units(text)), one.units(text)
    one.separable = False
    whole = one.align_all(one.units(text))
    assert one.units(text) == [text] and len(parts) == 3
    assert all((getattr(cut, n) == getattr(whole, n)).all() for n in ("a", "b", "from_a", "from_b")) and cut.start[-1] == whole.start[-1]


@pytest.mark.parametrize("n", [None, 0])
def test_op12(spark, sf, tmp_path, n):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    if n == 0:
        docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["op12_token_alignment"](spark, sf if n is None else str(tmp_path))
    assert got(out) == (plain([tuple(r) for r in docs.collect()]) if n is None else [])
