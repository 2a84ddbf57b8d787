"""Personal data in texts: fixed rules, and spans that labelers vote for and a classifier keeps."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import slices, stable, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _small(part: str) -> bool:
    """At most 255, however many zeros stand before."""
    return len(x := part.lstrip("0")) < 3 or (len(x) == 3 and x <= "255")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, left to right without overlaps: a name can't hold an @, so each @ has one possible
    name, which reaches back as far as it can, and time stays linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules, by start, then kind; matches that fail their check are dropped and what they
    cover is not tried again."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# what the labelers look at; fixed values

#: Ends of host names; issuers' first digits; country codes; areas that are not of this network.
ENDS = frozenset("com org net edu gov mil int info biz io co ai app dev me us uk ca au de fr es it nl be ch at se no dk fi pl pt cz ie eu ru cn jp kr in br mx ar za example".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|35|6(?:011|4|5)")
COUNTRIES = re.compile(r"(?:\+|00)(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
LOCAL_NETS = re.compile(r"(?:0|10|127|255)\.|192\.168\.|169\.254\.|(?:22[4-9]|23[0-9])\.")
#: Words that stand before data of a kind, and before numbers that are none, in English, German, French and Spanish.
NEAR = (
    frozenset("email e-mail mail mailto contact write reach kontakt schreiben courriel correo contacto escribir".split()),
    frozenset("ip address host server adresse serveur rechner servidor ipv4 ipv6 ping login client".split()),
    frozenset("card visa mastercard amex credit debit payment pay karte kreditkarte carte carta tarjeta pago zahlung".split()),
    frozenset("phone tel telephone call mobile cell fax telefon anruf handy téléphone appeler portable teléfono llamar móvil".split()),
)
AGAINST = frozenset("version v section chapter isbn issn order invoice sku model build release ratio score page pages no. nr. número numéro id token key hash checksum serial artikel kapitel seite chapitre".split())

AT = re.compile(r"\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s|\.)[A-Za-z0-9-]++)++", re.IGNORECASE)
LOOSE = (
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?:(?<![0-9])00[0-9]{1,2}[ ./-]?)?(?:\([0-9]{3}\)|(?<![0-9(])[0-9]{3})[ ./-]?[0-9]{3}[ ./-][0-9]{4}(?![0-9])")),
)
WORD = re.compile(r"[^\s\"'=:;,()\[\]{}<>]+")
AROUND = 40


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, is base): the spans of the fixed rules, and looser ones that touch none of those: addresses with
    the at and the dots in words, long ip addresses, card and phone numbers in other writings."""
    base = base_spans(text)
    loose = []
    for m in AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, m.end()) if start < m.start() else None
        if host and ("dot" in host[0].lower() or m[0].strip().lower() != "at"):
            loose.append((start, 0, host.end()))
    for kind, pattern in LOOSE:
        loose += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    out, taken = [(*s, True) for s in base], sorted((a, b) for a, _, b in base)
    if loose:
        starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0)
        for a, k, b in loose:
            i = int(np.searchsorted(starts, b))  # base spans that start before this one ends
            if not i or ends[i - 1] <= a:
                out.append((a, k, b, False))
    return sorted(out)


#: The labelers, in the order of their votes: the fixed rule, the writing, the check, the gazetteer, words before, words
#: against, the characters beside.
LABELERS = ("rule", "writing", "check", "gazetteer", "context", "against", "edges")


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """1, -1 or 0 (none) of each labeler."""
    s, before = text[start:end], [w.lower() for w in WORD.findall(text[max(0, start - AROUND) : start])]
    d = _digits(s)
    yes = lambda x: 1 if x else -1
    if kind == 0:
        end_ = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
        writing, check, gazetteer = yes("@" in s or "dot" in s.lower()), yes(end_.isalpha() and len(end_) >= 2), 1 if end_ in ENDS else 0
    elif kind == 1:
        parts = s.split(".")
        writing, check, gazetteer = yes(all(x == "0" or not x.startswith("0") for x in parts)), yes(len(parts) == 4 or len(set(s)) > 4), -1 if LOCAL_NETS.match(s) else 0
    elif kind == 2:
        writing, check, gazetteer = yes(len(d) in (14, 15, 16, 19) and len({*s} - {*"0123456789"}) <= 1), yes(luhn(d)), yes(ISSUERS.match(d))
    else:
        writing, check = yes(s[0] in "+(" or re.fullmatch(r"[0-9]{3}([ ./-])[0-9]{3}\1[0-9]{4}", s)), yes(10 <= len(d) <= 15)
        gazetteer = 1 if COUNTRIES.match(s) else yes(d.removeprefix("1")[:1] not in "01") if not base else 0
    beside = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    edges = -1 if any(c.isalnum() or c in "_=/\\\"" for c in beside) else 1 if beside[0].isspace() else 0
    return (1 if base else 0, writing, check, gazetteer, 1 if NEAR[kind] & set(before) else 0, -1 if AGAINST & set(before[-3:]) else 0, edges)


def shape(s: str) -> str:
    """s with digits as 9 and letters as a, runs of either as one with their number, in steps of a doubling."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", s, re.DOTALL):
        c, n = m[0][0], len(m[0])
        out.append(f"9{n.bit_length()}" if "0" <= c <= "9" else f"a{n.bit_length()}" if c.isalpha() else c)
    return "".join(out[:24])


#: Places of the hashed features.
PLACES = 1 << 14


def features(text: str, start: int, kind: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: each vote but the rule's, its writing, and the words and characters beside it."""
    s = text[start:end]
    before, behind = WORD.findall(text[max(0, start - AROUND) : start]), WORD.search(text, end, end + AROUND)
    said = [f"{n}={v}" for n, v in zip(LABELERS[1:], vote[1:], strict=True)]
    said += [f"shape={shape(s)}", f"digits={len(_digits(s))}", f"long={(end - start).bit_length()}", f"left={text[max(0, start - 1) : start]}", f"right={text[end : end + 1]}"]
    said += [f"before={w.lower()}" for w in before[-2:]] + [f"behind={behind[0].lower()}" if behind else "behind"]
    return [zlib.crc32(f"{KINDS[kind]} {x}".encode("utf-8", "surrogatepass")) % PLACES for x in said]


def vote_code(vote: tuple[int, ...]) -> int:
    code = 0
    for v in vote:
        code = 3 * code + v + 1
    return code


def votes_of(code: np.ndarray) -> np.ndarray:
    """The votes of each code, a column a labeler."""
    return np.stack([code // 3 ** (len(LABELERS) - 1 - i) % 3 - 1 for i in range(len(LABELERS))], 1)


@dataclass(frozen=True)
class Reliabilities:
    """Of a kind: the share of real spans, and for a real (1) and any other (0) span the chances of each vote."""

    prior: float
    chance: np.ndarray  # class, labeler, vote + 1

    def posterior(self, votes_: np.ndarray) -> np.ndarray:
        each = np.log(self.chance)[:, np.arange(votes_.shape[1]), votes_ + 1].sum(2)
        z = each[1] - each[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def estimate(votes_: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> Reliabilities:
    """Expectation-maximisation over vote patterns and their counts, from the majority's view: how likely each span is real
    under the reliabilities, then the reliabilities under that. Where two truths explain the votes alike, spans that the
    rule votes for are the real ones."""
    p = 0.5 + 0.45 * np.tanh(votes_.sum(1))
    out = Reliabilities(0.5, np.full((2, votes_.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        seen = np.stack([(weight[:, :, None] * (votes_ == v)).sum(1) for v in (-1, 0, 1)], 2) + smooth
        out = Reliabilities(float((weight[1].sum() + 1) / (counts.sum() + 2)), seen / seen.sum(2, keepdims=True))
        new = out.posterior(votes_)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    if out.chance[1, 0, 2] < out.chance[0, 0, 2]:
        out = Reliabilities(1 - out.prior, out.chance[::-1])
    return out


@dataclass(frozen=True)
class Model:
    reliabilities: dict[int, Reliabilities]
    weights: np.ndarray
    bias: float

    def scores(self, features_: list[list[int]]) -> np.ndarray:
        if not features_:
            return np.empty(0)
        which = np.repeat(np.arange(len(features_)), [len(f) for f in features_])
        z = np.bincount(which, self.weights[np.concatenate(features_)], len(features_)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(features_: list[list[int]], want: np.ndarray, rounds: int = 300, ridge: float = 1e-3, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic curve for soft labels, by steps that shrink with what a weight has moved."""
    w, b, moved, moved_b = np.zeros(PLACES), 0.0, np.full(PLACES, 1e-8), 1e-8
    which, at = np.repeat(np.arange(len(features_)), [len(f) for f in features_]), np.concatenate(features_)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(which, w[at], len(want)) + b, -30, 30)))
        error = (p - want) / len(want)
        grad, grad_b = np.bincount(at, error[which], PLACES) + ridge * w / len(want) ** 0.5, error.sum()
        moved, moved_b = moved + grad * grad, moved_b + grad_b * grad_b
        w, b = w - rate * grad / np.sqrt(moved), b - rate * grad_b / np.sqrt(moved_b)
    return w, float(b)


FOUND = "doc_id long, found array<struct<start:int,kind:int,end:int,base:boolean,code:int,features:array<int>>>"


def _found(text: str) -> list[dict]:
    out = []
    for a, k, b, base in candidates(text):
        v = votes(text, a, k, b, base)
        out.append({"start": a, "kind": k, "end": b, "base": base, "code": vote_code(v), "features": features(text, a, k, b, v)})
    return out


def find_candidates(docs: DataFrame) -> DataFrame:
    """FOUND of docs (doc_id, text): the candidates of each whole text with their votes and features; places count code
    points, ends are exclusive."""
    kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_found(t) for t in part.column("text").to_pylist()], pa.list_(kind))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, FOUND)


def fit(found: DataFrame, per_kind: int = 10_000) -> Model:
    """The labelers' reliabilities from the vote patterns of all candidates (at most 3 ** 7 a kind reach the driver), and a
    classifier of spans, trained on the chance that those give each of at most per_kind candidates of each kind, chosen
    by hashes. It doesn't see whether the fixed rule holds, so it can tell other writings. Without candidates every span
    scores 0.5."""
    each = found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    counts = each.groupBy("kind", "code").agg(F.count("*").alias("n")).collect()
    known = {}
    for k in sorted({r["kind"] for r in counts}):
        mine = sorted((r["code"], r["n"]) for r in counts if r["kind"] == k)
        known[k] = estimate(votes_of(np.asarray([c for c, _ in mine])), np.asarray([float(n) for _, n in mine]))
    rows = []
    for k in known:
        mine = each.where(F.col("kind") == k).orderBy(F.xxhash64("doc_id", "start", "end"), "doc_id", "start", "end", "code").select("code", "features").limit(per_kind).collect()
        chance = known[k].posterior(votes_of(np.asarray([r["code"] for r in mine])))
        rows += [(r["features"], p) for r, p in zip(mine, chance.tolist(), strict=True)]
    if not rows:
        return Model({}, np.zeros(PLACES), 0.0)
    return Model(known, *_logistic([f for f, _ in rows], np.asarray([p for _, p in rows])))


def chosen(found: list[dict], model: Model, threshold: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans and of others that score at least the threshold and touch no better one."""
    out = [(x["start"], x["kind"], x["end"]) for x in found if x["base"]]
    more = [x for x in found if not x["base"]]
    taken: list[tuple[int, int]] = []  # apart from each other and in order
    for p, x in sorted(zip(model.scores([x["features"] for x in more]).tolist(), more, strict=True), key=lambda y: (-y[0], y[1]["start"], y[1]["kind"])):
        i = bisect.bisect_left(taken, (x["end"],))  # those before it start before its end
        if p >= threshold and (not i or taken[i - 1][1] <= x["start"]):
            taken.insert(i, (x["start"], x["end"]))
            out.append((x["start"], x["kind"], x["end"]))
    return sorted(out)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


#: The score from which a span is added to those of the rules.
THRESHOLD = 0.7


def spans_of(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of every row of find_candidates: counts and
    digest of the rules' spans, and all spans with those added. Null and repeated ids are rows like any other; without
    candidates all counts are 0 and spans is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "found", 10_000):
            rows = []
            for found in part.column("found").to_pylist():
                base = [(x["start"], x["kind"], x["end"]) for x in found if x["base"]]
                all_ = chosen(found, model, threshold)
                rows.append((*[sum(k == i for _, k, _ in base) for i in range(4)], len(all_) - len(base), hashlib.sha256(said(base).encode()).hexdigest(), said(all_)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"])

    return found.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, n_added long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; of spans that reach into each other the text of
    all goes and the first gives the kind. A null text stays null, all other columns stay as they are."""

    @F.udf("string", useArrow=True)
    def replaced(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for a, k, b in chosen(_found(t), model, threshold):
            if a >= at:
                out += [t[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    return docs.withColumn(text, replaced(F.col(text)))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labelers and classifier learn from the same documents' candidates, which are written once."""
    found = stable(find_candidates(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spans_of(found, fit(found))
