"""A gated recurrent language model in numpy, with a class-factored softmax and truncated backpropagation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class Shape:
    words: int  # words with an output of their own
    extra: int  # classes that stand for all other words of a kind
    width: int = 64  # words of a class
    embed: int = 32
    hidden: int = 32

    @property
    def classes(self) -> int:
        return -(-self.words // self.width)

    def parts(self) -> dict[str, tuple[int, ...]]:
        c, h = self.classes, self.hidden
        return {
            "E": (self.words + self.extra, self.embed), "Wx": (self.embed, 3 * h), "b": (3 * h,), "U": (h, 3 * h),
            "Wc": (h, c + self.extra), "bc": (c + self.extra,), "Wo": (c, h, self.width), "bo": (c, self.width),
        }


def start(shape: Shape, counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """First weights; the output biases say what counts (of words, then of the other classes) say."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.1 if k == "E" else 1 / math.sqrt(s[-2]))).astype(F32) if len(s) > 1 else np.zeros(s, F32) for k, s in shape.parts().items()}
    p["Wc"] *= F32(0.1)
    p["Wo"] *= F32(0.1)
    c = np.maximum(counts.astype(np.float64), 0.5)
    own = np.full(shape.classes * shape.width, 1e-9)
    own[: shape.words] = c[: shape.words]
    own = own.reshape(shape.classes, shape.width)
    p["bo"] = np.where(own > 1e-9, np.log(own / own.sum(1, keepdims=True)), -1e9).astype(F32)
    p["bc"] = np.log(np.concatenate([own.sum(1), c[shape.words :]]) / c.sum()).astype(F32)
    return p


def _sigmoid_of_minus(x: np.ndarray) -> None:
    """In place, the sigmoid of -x; exp is cheaper than tanh. An infinite exponential gives 0, as it should; callers
    silence its warning."""
    np.exp(x, out=x)
    x += F32(1)
    np.divide(F32(1), x, out=x)


def _tanh_of_minus_half(x: np.ndarray) -> None:
    """In place, the hyperbolic tangent of -x / 2."""
    np.exp(x, out=x)
    x += F32(1)
    np.divide(F32(2), x, out=x)
    x -= F32(1)


def _gate_tables(e: np.ndarray, p: dict, hid: int) -> tuple[np.ndarray, np.ndarray]:
    """What the words with embeddings e, then the state, add to the gates z and r, negative, and to n, times -2."""
    scale = np.repeat([F32(-1), F32(-2)], [2 * hid, hid])
    table = e @ (p["Wx"] * scale)
    table += p["b"] * scale
    return table, p["U"] * scale


def _alike(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ids below `most`, where runs of equal ids begin in it, their ids, and each id's run."""
    order = np.argsort(ids.astype(np.min_scalar_type(most)), kind="stable")
    x = ids[order]
    new = np.diff(x, prepend=-1) > 0
    place = np.empty(len(ids), np.intp)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order, first, x[first], place


def _sums_of_runs(x: np.ndarray, first: np.ndarray, short: int = 8) -> np.ndarray:
    """The sum of each run of rows of x: of short ones all first rows, then all second rows, of the others one by one."""
    n = np.diff(first, append=len(x))
    out = np.take(x, first, 0)
    few = np.flatnonzero((n > 1) & (n <= short))
    for k in range(1, short):
        few = few[n[few] > k]
        if not len(few):
            break
        out[few] += np.take(x, first[few] + k, 0)
    ones = np.ones(int(n.max()), x.dtype)
    for i in np.flatnonzero(n > short).tolist():
        np.matmul(ones[: n[i]], x[first[i] : first[i] + n[i]], out=out[i])
    return out


def _gathered(classes: list[tuple[int, int, int]], rows: int) -> Iterator[list[tuple[int, int, int]]]:
    """Classes in turn, in lists of at most so many rows; a class of more is alone."""
    some, n = [], 0
    for k, i, j in classes:
        if some and n + j - i > rows:
            yield some
            some, n = [], 0
        some.append((k, i, j))
        n += j - i
    if some:
        yield some


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(v: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in sorted(shape.parts().items()):
        n = math.prod(s)
        out[k] = v[at : at + n].reshape(s).astype(F32)
        at += n
    return out


def _by_class(shape: Shape, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The rows of words with outputs of their own in the order of their classes, and (class, from, to) in that order."""
    own = np.flatnonzero(ids < shape.words)
    c = ids[own] // shape.width
    order = np.argsort(c.astype(np.min_scalar_type(shape.classes)), kind="stable")
    edges = np.searchsorted(c[order], np.arange(shape.classes + 1)).tolist()
    return own[order], [(k, i, j) for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]


def _class_of(shape: Shape, ids: np.ndarray) -> np.ndarray:
    return np.where(ids < shape.words, ids // shape.width, ids - shape.words + shape.classes)


def _tame(w: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit can be large enough for its exponential to overflow; states lie within -1 and 1."""
    high = float(bias.max())
    if max(float(w.max()), -float(w.min())) * w.shape[-2] + high >= 80 and float(np.abs(w).sum(-2).max()) + high >= 80:
        return False
    return high > -80


def _picked(x: np.ndarray, at: np.ndarray, tame: bool) -> np.ndarray:
    """The log softmax of each row of x at one place."""
    if not tame:
        x -= x.max(1, keepdims=True)
    found = x[np.arange(len(at)), at]
    np.exp(x, out=x)
    return found - np.log(x @ np.ones(x.shape[1], x.dtype))


def log_probs(p: dict, shape: Shape, h: np.ndarray, ids: np.ndarray, rows: int = 1024, block: int = 32_768) -> np.ndarray:
    """Natural log of the probability of each id (a word, or the class of other words) after state h; some rows at a
    time, so that they stay in the processor's cache, and more in the order of their classes."""
    out = np.empty(len(ids))
    tame = _tame(p["Wc"], p["bc"]), _tame(p["Wo"], p["bo"])
    x = np.empty((rows, max(len(p["bc"]), shape.width)), h.dtype)
    logits = [x.ravel()[: rows * n].reshape(rows, n) for n in (len(p["bc"]), shape.width)]
    for at in range(0, len(ids), block):
        h_, ids_ = h[at : at + block], ids[at : at + block]
        found, class_ = np.empty(len(ids_), h.dtype), _class_of(shape, ids_)
        for i in range(0, len(ids_), rows):
            part = slice(i, i + rows)
            x = np.matmul(h_[part], p["Wc"], out=logits[0][: len(ids_) - i])
            x += p["bc"]
            found[part] = _picked(x, class_[part], tame[0])
        order, classes = _by_class(shape, ids_)
        h_, inside, own = np.take(h_, order, 0), np.empty(len(order), h.dtype), ids_[order] % shape.width
        for some in _gathered([(k, a, min(a + rows, j)) for k, i, j in classes for a in range(i, j, rows)], rows):
            lo, hi = some[0][1], some[-1][2]
            for k, i, j in some:
                x = np.matmul(h_[i:j], p["Wo"][k], out=logits[1][i - lo : j - lo])
                x += p["bo"][k]
            inside[lo:hi] = _picked(logits[1][: hi - lo], own[lo:hi], tame[1])
        found = found.astype(np.float64)
        found[order] += inside
        out[at : at + block] = found
    return out


@np.errstate(over="ignore")
def score(p: dict, shape: Shape, docs: list[np.ndarray], end: int, window: int = 32, rows: int = 16_384, group: int = 1024) -> np.ndarray:
    """Natural log-likelihood of each whole document, which ends in `end`; its state runs on from window to window.

    A group of documents takes a step together, the longest first, so that those still running are a prefix. A window
    has so many steps, and goes on until it has so many rows, as each has a cost of its own.
    """
    if not docs:
        return np.zeros(0)
    n = np.asarray([len(d) for d in docs])
    order = np.argsort(-n, kind="stable")
    n_, docs_ = n[order], [docs[i] for i in order]
    starts = np.cumsum(n_) - n_
    ids = np.concatenate(docs_)
    total = np.zeros(len(docs))
    hid = shape.hidden
    table, u = _gate_tables(p["E"], p, hid)
    table_zr, table_n = np.ascontiguousarray(table[:, : 2 * hid]), np.ascontiguousarray(table[:, 2 * hid :])
    u_zr, u_n = np.ascontiguousarray(u[:, : 2 * hid]), np.ascontiguousarray(u[:, 2 * hid :])
    for g in range(0, len(docs), group):
        n_g, starts_g = n_[g : g + group], starts[g : g + group]
        h, last = np.zeros((len(n_g), hid), F32), np.full(len(n_g), end)
        live = np.searchsorted(-n_g, -np.arange(int(n_g[0])), side="left").tolist()  # documents longer than each step
        states, want, who, held = [], [], [], 0
        for s, a in enumerate(live):
            hp, at = h[:a], last[:a]
            zr = np.take(table_zr, at, 0)
            zr += hp @ u_zr
            _sigmoid_of_minus(zr)
            new = hp @ u_n
            new *= zr[:, hid:]
            new += np.take(table_n, at, 0)
            _tanh_of_minus_half(new)
            h = hp - new
            h *= zr[:, :hid]
            h += new
            last = ids[starts_g[:a] + s]
            states.append(h)
            want.append(last)
            who.append(np.arange(g, g + a))
            held += a
            if len(states) >= window and held >= rows or s == len(live) - 1:
                total += np.bincount(np.concatenate(who), log_probs(p, shape, np.concatenate(states), np.concatenate(want)), len(docs))
                states, want, who, held = [], [], [], 0
    out = np.empty(len(docs))
    out[order] = total
    return out


class Trainer:
    """Adam over windows of `window` steps in `streams` parallel streams of documents; a state never enters the next
    document, and gradients stop at the window's edge. Arrays of a window have a row for each step and stream, step by
    step, and are kept for the next window, as new memory costs more than the sums in it."""

    def __init__(self, p: dict, shape: Shape, rate: float, window: int = 20, streams: int = 256):
        self.p, self.shape, self.rate, self.window, self.streams = {k: v.copy() for k, v in p.items()}, shape, rate, window, streams
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0
        self.kept: dict[str, np.ndarray] = {}

    def room(self, name: str, *size: int) -> np.ndarray:
        """An array with whatever it held before."""
        n = math.prod(size)
        if name not in self.kept or self.kept[name].size < n:
            self.kept[name] = np.empty(n, F32)
        return self.kept[name][:n].reshape(size)

    def run(self, docs: list[np.ndarray], end: int) -> None:
        """One pass over docs, dealt out to the streams in turn."""
        if not docs:
            return
        ids = np.concatenate(docs)
        b = max(1, min(self.streams, len(ids) // (2 * self.window)))
        length = -(-len(ids) // b)
        fill = np.full(b * length, -1)
        fill[: len(ids)] = ids
        fill = np.ascontiguousarray(fill.reshape(b, length).T)  # steps x streams
        h = np.zeros((self.shape.hidden, b), F32)
        last = np.full(b, end)
        for s in range(0, length, self.window):
            want = fill[s : s + self.window]
            before = np.concatenate([last[None], want[:-1]])
            h = self.step(np.maximum(before, 0), want, h, before == end)
            last = want[-1]

    @np.errstate(over="ignore")
    def step(self, before: np.ndarray, want: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Learns from one window; h and what is returned are the streams' states before and after it, a column each."""
        p, sh, room = self.p, self.shape, self.room
        hid, (steps, b) = sh.hidden, before.shape
        order, first, words, place = _alike(before.ravel(), sh.words + sh.extra)
        place = place.reshape(steps, b)
        e = np.take(p["E"], words, 0)
        table, u = _gate_tables(e, p, hid)
        hs, ns, qs, zrs = room("h", steps + 1, b, hid), room("n", steps, b, hid), room("q", steps, b, hid), room("zr", steps, b, 2 * hid)
        q, x = room("state's", b, 3 * hid), room("word's", b, 3 * hid)
        at, which = np.nonzero(fresh)
        edges = np.searchsorted(at, np.arange(steps + 1)).tolist()
        new = [which[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        hs[0] = h.T
        for s in range(steps):
            h, zr, n = hs[s], zrs[s], ns[s]
            if len(new[s]):
                h = h.copy()
                h[new[s]] = 0
            np.matmul(h, u, out=q)
            np.take(table, place[s], 0, out=x, mode="clip")
            np.add(x[:, : 2 * hid], q[:, : 2 * hid], out=zr)
            _sigmoid_of_minus(zr)
            qs[s] = q[:, 2 * hid :]
            np.multiply(qs[s], zr[:, hid:], out=n)
            n += x[:, 2 * hid :]
            _tanh_of_minus_half(n)
            h = np.subtract(h, n, out=hs[s + 1])
            h *= zr[:, :hid]
            h += n
        h = h.T.copy()
        grad, dout = self.output_gradients(hs[1:].reshape(-1, hid), want.ravel())
        hp = hs[:-1]  # states before the steps; what comes after them has been used
        hp[at, which] = 0
        dout = dout.reshape(steps, b, hid)
        # what a change of the state does to the gates before their functions
        one, half = F32(1), F32(-0.5)  # q is minus twice the state's part of n; r's share of g is so until its sums are taken
        g, dns = room("g", steps, b, 3 * hid), room("dn", steps, b, hid)
        dh, back, x, y = (room(k, b, hid) for k in ("dh", "back", "x", "y"))
        dh[:] = 0
        u = np.ascontiguousarray(p["U"].T)
        u[hid : 2 * hid] *= half
        for s in range(steps - 1, -1, -1):
            z, r, n, dn, ds = zrs[s, :, :hid], zrs[s, :, hid:], ns[s], dns[s], g[s]
            dh += dout[s]
            np.subtract(one, z, out=x)
            np.multiply(n, n, out=dn)
            np.subtract(one, dn, out=dn)
            dn *= x
            dn *= dh
            x *= z
            dh_z = ds[:, :hid]
            np.subtract(hp[s], n, out=y)
            y *= x
            np.multiply(y, dh, out=dh_z)
            np.subtract(one, r, out=x)
            x *= r
            x *= qs[s]
            np.multiply(x, dn, out=ds[:, hid : 2 * hid])
            np.multiply(dn, r, out=ds[:, 2 * hid :])
            dh *= z
            dh += np.matmul(ds, u, out=back)
            if len(new[s]):
                dh[new[s]] = 0
        flat_g = g.reshape(-1, 3 * hid)
        grad["U"] = (flat_g.T @ hp.reshape(-1, hid)).T
        grad["U"][:, hid : 2 * hid] *= half
        g[:, :, 2 * hid :] = dns
        of_words = _sums_of_runs(np.take(flat_g, order, 0, out=room("sorted", *flat_g.shape), mode="clip"), first)
        of_words[:, hid : 2 * hid] *= half
        grad["Wx"], grad["b"], grad["E"] = e.T @ of_words, of_words.sum(0), of_words @ p["Wx"].T
        self.update(grad, words)
        return h

    def output_gradients(self, hs: np.ndarray, ids: np.ndarray, rows: int = 1024) -> tuple[dict, np.ndarray]:
        """Gradients of the output weights, and of the states hs (a row each), of the mean loss over ids of 0 or more."""
        p, sh, room = self.p, self.shape, self.room
        use = ids >= 0
        n = F32(1 / max(1, int(use.sum())))
        weight = n * use.astype(hs.dtype)
        class_, at = _class_of(sh, np.where(use, ids, 0)), np.arange(len(ids))
        grad = {"Wc": np.zeros_like(p["Wc"]), "bc": np.zeros_like(p["bc"]), "Wo": room("grad of Wo", *p["Wo"].shape), "bo": np.zeros_like(p["bo"])}
        dout, w = room("dout", *hs.shape), np.ascontiguousarray(p["Wc"].T)
        tame, ones = _tame(p["Wc"], p["bc"]), np.ones(max(len(ids), len(p["bc"]), sh.width), hs.dtype)
        for i in range(0, len(ids), rows):
            h, part = hs[i : i + rows], slice(i, i + rows)
            d = np.matmul(h, p["Wc"], out=room("d", len(h), len(p["bc"])))
            d += p["bc"]
            if not tame:
                d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d *= (weight[part] / (d @ ones[: d.shape[1]]))[:, None]
            d[at[: len(h)], class_[part]] -= weight[part]
            grad["Wc"] += (d.T @ h).T
            grad["bc"] += ones[: len(h)] @ d
            np.matmul(d, w, out=dout[part])
        order, classes = _by_class(sh, np.where(use, ids, sh.words))
        out, inside = np.take(hs, order, 0, out=room("out", len(order), sh.hidden), mode="clip"), ids[order] % sh.width
        back, tame = room("inside", len(order) + 1, sh.hidden), _tame(p["Wo"], p["bo"])
        back[-1] = 0  # for rows without an own output
        place = np.full(len(ids), len(order))
        place[order] = at[: len(order)]
        grad["Wo"][np.setdiff1d(np.arange(sh.classes), [k for k, _, _ in classes])] = 0
        for some in _gathered(classes, rows):
            lo, hi = some[0][1], some[-1][2]
            d = room("d", hi - lo, sh.width)
            for k, i, j in some:
                x = np.matmul(out[i:j], p["Wo"][k], out=d[i - lo : j - lo])
                x += p["bo"][k]
            if not tame:
                d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d *= (n / (d @ ones[: sh.width]))[:, None]
            d[at[: hi - lo], inside[lo:hi]] -= n
            for k, i, j in some:
                x = d[i - lo : j - lo]
                np.matmul(out[i:j].T, x, out=grad["Wo"][k])
                np.matmul(ones[: j - i], x, out=grad["bo"][k])
                np.matmul(x, p["Wo"][k].T, out=back[i:j])
        dout += np.take(back, place, 0, out=room("d", *hs.shape), mode="clip")
        return grad, dout

    def update(self, grad: dict, words: np.ndarray, b1: float = 0.9, b2: float = 0.99) -> None:
        """One step of Adam; of the embedding only the rows of `words` move."""
        self.t += 1
        rate = F32(self.rate * math.sqrt(1 - b2**self.t) / (1 - b1**self.t))
        size = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        scale = F32((1 - b1) * min(1.0, 1.0 / max(size, 1e-9)))
        for k, g in grad.items():
            at = words if k == "E" else slice(None)
            m, v = self.m[k][at], self.v[k][at]
            g *= scale
            m *= F32(b1)
            m += g
            g *= g
            g *= F32((1 - b2) / (1 - b1) ** 2)
            v *= F32(b2)
            v += g
            if k == "E":
                self.m[k][at], self.v[k][at] = m, v
            np.sqrt(v, out=g)
            g += F32(1e-6)
            np.divide(m, g, out=g)
            g *= rate
            self.p[k][at] -= g
