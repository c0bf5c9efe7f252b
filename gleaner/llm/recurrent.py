"""A gated recurrent language model in numpy with a class-factored softmax over the head of the vocabulary."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

HIDDEN, CLASSES = 16, 32
#: Parallel streams of documents in scoring and in training, and steps after which gradients are cut.
LANES, TRAIN_LANES, WINDOW = 256, 256, 32
#: Steps of gradients that a pass over few tokens makes at least, their rate, and where their squares start.
STEPS, RATE, FIRST = 200, 0.05, 1e-4
END, REST = 0, 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


@dataclass
class Weights:
    """Tokens 0..size-1, the frequent ones first; class c holds the tokens cuts[c] to cuts[c + 1].

    Token REST stands for every word outside the head. Classes have equal sums of the square roots of
    counts, which makes frequent words cheap: few of them share a class.
    """

    cuts: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return int(self.cuts[-1])

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Weights:
        """Small random weights, and biases by which training starts at the distribution of the counts."""
        mass = np.cumsum(np.sqrt(counts + 0.1))
        inner = np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES) + 1
        cuts = np.unique(np.concatenate(([0], np.minimum(inner, len(counts)), [len(counts)])))
        n, h, r, f = len(counts), HIDDEN, np.random.default_rng(0), np.float32
        share = (counts + 0.1) / (counts + 0.1).sum()
        of_class = np.add.reduceat(share, cuts[:-1])
        w = cls(cuts)
        w.p = {
            "embed": r.normal(0, 0.2, (n + 1, 3 * h)).astype(f),  # the last row: before the first token
            "u": r.normal(0, 0.15, (h, 3 * h)).astype(f),
            "class_w": r.normal(0, 0.05, (h, len(of_class))).astype(f), "class_b": np.log(of_class).astype(f),
            "word_w": r.normal(0, 0.05, (n, h)).astype(f), "word_b": np.log(share / np.repeat(of_class, np.diff(cuts))).astype(f),
        }
        return w

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Weights:
        at, out = 0, Weights(self.cuts)
        for k in sorted(self.p):
            n = self.p[k].size
            out.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return out

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = HIDDEN
        x, g = self.p["embed"][inputs], h @ self.p["u"]
        rz = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
        r, z, hu = rz[:, :k], rz[:, k:], g[:, 2 * k :]
        c = np.tanh(x[:, 2 * k :] + r * hu)
        return h + z * (c - h), r, z, c, hu

    def log_probs(self, hs: np.ndarray, targets: np.ndarray, learn=None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the targets; with learn(name, rows, gradient), also the gradient at hs.

        Biases are logarithms of shares to begin with and states lie between -1 and 1, so no exponential comes
        near the range of 32 bits.
        """
        p, cuts = self.p, self.cuts
        cls = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint8), np.diff(cuts))[targets]  # small numbers are sorted by counting
        a = hs @ p["class_w"] + p["class_b"]
        out = a[np.arange(len(hs)), cls]
        e = np.exp(a, out=a)
        s = e.sum(1)
        out -= np.log(s)
        back, later = None, []
        if learn is not None:
            e /= s[:, None]
            e[np.arange(len(hs)), cls] -= 1
            later += [("class_w", slice(None), hs.T @ e), ("class_b", slice(None), e.sum(0))]
            back = e @ p["class_w"].T
        order = np.argsort(cls, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=len(cuts) - 1))))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            at, own = order[bounds[c] : bounds[c + 1]], slice(cuts[c], cuts[c + 1])
            if own.stop - own.start == 1:
                continue  # the one word of a class is certain in it
            h, w, m = hs[at], p["word_w"][own], np.arange(len(at))
            b = h @ w.T
            b += p["word_b"][own]
            word = targets[at] - cuts[c]
            mine = b[m, word]
            e = np.exp(b, out=b)
            s = e.sum(1)
            out[at] += mine - np.log(s)
            if learn is not None:
                e /= s[:, None]
                e[m, word] -= 1
                back[at] += e @ w
                later += [("word_w", own, e.T @ h), ("word_b", own, e.sum(0))]
        for x in later:
            learn(*x)
        return out, back


def streams(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the lane with the fewest steps so far."""
    heap = [(0, i) for i in range(min(lanes, max(1, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heap[0]
        out[i].append(d)
        heapq.heapreplace(heap, (n + int(lengths[d]), i))
    return out


def windows(tokens: np.ndarray, lengths: np.ndarray, lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, documents, first) of each window of the lanes' streams; rows are steps, document -1 is none.

    Lanes are ordered by length, so those of a window are the first ones; the state of a lane is carried
    from one window to the next and reset where a document begins.
    """
    dealt = sorted(streams(lengths, lanes), key=lambda ds: -int(lengths[ds].sum()))
    begin = np.cumsum(lengths) - lengths
    docs = np.array([d for ds in dealt for d in ds], np.int64)
    total = np.array([int(lengths[ds].sum()) for ds in dealt])
    n = lengths[docs]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lane = np.repeat(np.arange(len(dealt)), total)
    step = np.arange(len(lane)) - np.repeat(np.cumsum(total) - total, total)
    flat, owner = np.repeat(begin[docs], n) + place, np.repeat(docs, n)
    order = np.argsort(step // WINDOW, kind="stable")
    bounds = np.searchsorted((step // WINDOW)[order], np.arange(-(-int(total.max(initial=0)) // WINDOW) + 1))
    for w in range(len(bounds) - 1):
        at = order[bounds[w] : bounds[w + 1]]
        k = int((total > w * WINDOW).sum())
        x, d, f = np.zeros((WINDOW, k), np.int64), np.full((WINDOW, k), -1), np.zeros((WINDOW, k), bool)
        i = (step[at] - w * WINDOW, lane[at])
        x[i], d[i], f[i] = tokens[flat[at]], owner[at], place[at] == 0
        yield x, d, f


def score(w: Weights, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The natural log-probability of each document's tokens, with the state carried through it whole."""
    out = np.zeros(len(lengths))
    h, last = np.zeros((LANES, HIDDEN), np.float32), np.full(LANES, w.size)
    for x, d, first in windows(tokens, lengths, LANES):
        k, hs = x.shape[1], np.empty((*x.shape, HIDDEN), np.float32)
        state, before, new = h[:k], last[:k], first.any(1)
        for t in range(len(x)):
            if new[t]:
                state = np.where(first[t][:, None], np.float32(0), state)
                before = np.where(first[t], w.size, before)
            state = w.step(before, state)[0]
            hs[t], before = state, x[t]
        h[:k], last[:k] = state, before
        active = d >= 0
        lp, _ = w.log_probs(hs[active], x[active])
        out += np.bincount(d[active], weights=lp, minlength=len(out))
    return out


def train(w: Weights, tokens: np.ndarray, lengths: np.ndarray, rate: float = RATE) -> Weights:
    """One pass of truncated backpropagation through time over the documents, by Adagrad, which changes w."""
    squares = {k: np.full_like(v, FIRST) for k, v in w.p.items()}
    lanes = min(TRAIN_LANES, max(8, len(tokens) // (WINDOW * STEPS)))
    h, last = np.zeros((lanes, HIDDEN), np.float32), np.full(lanes, w.size)
    k1 = HIDDEN
    for x, d, first in windows(tokens, lengths, lanes):
        steps, k = x.shape
        active = d >= 0
        scale = np.float32(1 / np.sqrt(max(1, active.sum())))

        def learn(name: str, rows, g: np.ndarray, scale=scale) -> None:
            g = g * scale
            seen = squares[name][rows] + g * g
            squares[name][rows] = seen
            w.p[name][rows] -= rate * g / np.sqrt(seen)

        inputs, prev, hs = np.empty_like(x), np.empty((steps, k, k1), np.float32), np.empty((steps, k, k1), np.float32)
        gates = []
        state, before, new = h[:k], last[:k], first.any(1)
        for t in range(steps):
            if new[t]:
                state = np.where(first[t][:, None], np.float32(0), state)
                before = np.where(first[t], w.size, before)
            inputs[t], prev[t] = before, state
            state, *rest = w.step(before, state)
            gates.append(rest)
            hs[t], before = state, x[t]
        h[:k], last[:k] = state, before
        back = np.zeros_like(hs)
        _, back[active] = w.log_probs(hs[active], x[active], learn)
        dx, dg = np.empty((steps, k, 3 * k1), np.float32), np.empty((steps, k, 3 * k1), np.float32)
        dh, u = np.zeros((k, k1), np.float32), np.ascontiguousarray(w.p["u"].T)
        r, z, c, hu = (np.stack(g) for g in zip(*gates, strict=True))
        keep = 1 - z
        to_c, to_z, to_r = z * (1 - c * c), (c - prev) * z * keep, hu * r * (1 - r)
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            own = dx[t]
            dc = np.multiply(dh, to_c[t], out=own[:, 2 * k1 :])
            np.multiply(dh, to_z[t], out=own[:, k1 : 2 * k1])
            np.multiply(dc, to_r[t], out=own[:, :k1])
            dg[t, :, : 2 * k1] = own[:, : 2 * k1]
            np.multiply(dc, r[t], out=dg[t, :, 2 * k1 :])
            dh *= keep[t]
            dh += dg[t] @ u
            if new[t]:
                dh[first[t]] = 0
        learn("u", slice(None), prev.reshape(-1, k1).T @ dg.reshape(-1, 3 * k1))
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.uint16) if w.size < 1 << 16 else flat, kind="stable")  # of 16 bits, sorted by counting
        at = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        learn("embed", flat[order][at], np.add.reduceat(dx.reshape(-1, 3 * k1)[order], at, axis=0))
    return w
