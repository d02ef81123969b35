"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the embedding of its hash beside the mean embedding of its
character n-grams. Two recurrent passes read a window of words; attention pools
their states into one logit. Gradients are written out by hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from voxmill.llm.text import ranges, span_hashes, spans

WORDS, CHARS = 1 << 15, 1 << 15
GRAMS = (3, 5)
DIM, HIDDEN, ATTEND = 8, 8, 8
WINDOW, STRIDE = 64, 32
BLOCK = 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Words:
    """The words of a slice of texts: distinct ones with their inputs, and where they occur."""

    word: np.ndarray  # embedding row of each distinct word
    grams: np.ndarray  # embedding rows of all its character n-grams, one after the other
    ends: np.ndarray  # first n-gram of each distinct word, and the total
    at: np.ndarray  # distinct word of each word
    rows: np.ndarray  # first word of each text, and the total


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, stops, rows = spans(data, offsets)
    if not len(starts):
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(1, np.int64), zero, rows)
    h, first, at = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
    starts, stops = starts[first], stops[first]
    parts, owners = [], []
    for n in GRAMS:
        # a word shorter than n is one n-gram of its own
        size = np.maximum(stops - starts - n + 1, 1)
        begin = ranges(starts, size)
        owner = np.repeat(np.arange(len(starts)), size)
        parts.append((span_hashes(data, begin, np.minimum(begin + n, stops[owner])) >> np.uint64(40)).astype(np.int64) % CHARS)
        owners.append(owner)
    owner, grams = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(starts)), out=ends[1:])
    return Words((h >> np.uint64(33)).astype(np.int64) % WORDS, grams[order], ends, at.reshape(-1), rows)


def joined(parts: list[Words]) -> Words:
    """Several slices as one; a word of two slices stays twice."""
    at, grams, word, rows = 0, 0, 0, []
    moved = []
    for w in parts:
        moved.append((w.ends[:-1] + grams, w.at + word))
        rows.append(w.rows[:-1] + at)
        at, grams, word = at + len(w.at), grams + len(w.grams), word + len(w.word)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Words(cat([w.word for w in parts]), cat([w.grams for w in parts]), np.append(cat([e for e, _ in moved]), grams), cat([a for _, a in moved]), np.append(cat(rows), at))


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows; the last one of a long text ends with it."""
    n = np.diff(rows)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    k = ranges(np.zeros(len(n), np.int64), count)
    start = rows[:-1][text] + np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, start, np.minimum(n[text], WINDOW)


@dataclass
class Network:
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        r = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        p = {"word": r(WORDS, DIM, scale=0.05), "char": r(CHARS, DIM, scale=0.05), "a": r(2 * HIDDEN, ATTEND, scale=0.3), "u": r(ATTEND, scale=0.3), "out": r(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"x{d}": r(2 * DIM, 3 * HIDDEN, scale=0.3), f"h{d}": r(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p)

    def inputs(self, w: Words, used: np.ndarray | None = None) -> np.ndarray:
        """The input of each (used) distinct word."""
        p = self.params
        if used is None:
            if not len(w.word):
                return np.zeros((0, 2 * DIM), np.float32)
            char = np.add.reduceat(p["char"][w.grams], w.ends[:-1]) / np.diff(w.ends)[:, None]
            return np.hstack([p["word"][w.word], char.astype(np.float32)])
        size = (w.ends[1:] - w.ends[:-1])[used]
        grams = w.grams[ranges(w.ends[:-1][used], size)]
        char = np.add.reduceat(p["char"][grams], np.cumsum(size) - size) / size[:, None]
        return np.hstack([p["word"][w.word[used]], char.astype(np.float32)])

    def run(self, gates: dict[str, np.ndarray], at: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ``at`` holds its words' rows in ``gates``, filled up with 0 behind ``size``."""
        p, (n, steps), H = self.params, at.shape, HIDDEN
        states = np.empty((steps, n, 2 * H), np.float32)
        short = size.min(initial=steps) < steps
        for d, cols in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            h, x, u = np.zeros((n, H), np.float32), gates[d], p[f"h{d}"]
            kept = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g, hu = x[at[:, t]], h @ u
                zr = sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
                if short:
                    on = (t < size)[:, None]
                    z = np.where(on, z, np.float32(1))
                if keep is not None:
                    kept.append((t, h, z, r, new, hu[:, 2 * H :]))
                h = new + z * (h - new)
                states[t][:, cols] = h
            if keep is not None:
                keep[d] = kept
        att = np.tanh(states @ p["a"])
        e = att @ p["u"]
        if short:
            e = np.where(np.arange(steps)[:, None] < size, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        if keep is not None:
            keep |= {"states": states, "att": att, "alpha": alpha, "pooled": pooled}
        return pooled @ p["out"] + p["bias"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.params[f"x{d}"] + self.params[f"c{d}"] for d in "fb"}

    def logits(self, w: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logit of every window of a slice."""
        gates, out = self.gates(self.inputs(w)), np.empty(len(start), np.float32)
        for steps in np.unique(np.minimum(-(-size // 16) * 16, WINDOW)):  # short windows in four lengths
            own = np.flatnonzero(np.minimum(-(-size // 16) * 16, WINDOW) == steps)
            for lo in range(0, len(own), BLOCK):
                i = own[lo : lo + BLOCK]
                k = np.arange(steps)
                at = w.at[np.minimum(start[i, None] + k, len(w.at) - 1)]
                out[i] = self.run(gates, np.where(k < size[i, None], at, 0), size[i])
        return out

    def gradients(self, w: Words, start: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of a batch of windows."""
        p, H = self.params, HIDDEN
        k = np.arange(WINDOW)
        on = k < size[:, None]
        used, at = np.unique(w.at[np.minimum(start[:, None] + k, len(w.at) - 1)], return_inverse=True)
        at = np.where(on, at.reshape(on.shape), 0)
        x, keep = self.inputs(w, used), {}
        logit = self.run(self.gates(x), at, size, keep)
        d_logit = (sigmoid(logit) - label).astype(np.float32) / len(label)
        g = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        states, att, alpha = keep["states"], keep["att"], keep["alpha"]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_att = d_e[..., None] * p["u"] * (1 - att**2)
        g |= {"u": np.einsum("tn,tna->a", d_e, att), "a": np.einsum("tnh,tna->ha", states, d_att)}
        d_states = alpha[..., None] * d_pooled + d_att @ p["a"].T
        d_x = np.zeros_like(x)
        for d, cols in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            d_h, d_gates = np.zeros((len(label), H), np.float32), np.zeros((len(x), 3 * H), np.float32)
            g[f"h{d}"] = np.zeros_like(p[f"h{d}"])
            for t, h, z, r, new, hn in reversed(keep[d]):
                d_h = d_h + d_states[t][:, cols]
                d_new = d_h * (1 - z) * (1 - new**2)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                to_h = np.hstack([d_z, d_r, d_new * r])
                g[f"h{d}"] += h.T @ to_h
                np.add.at(d_gates, at[:, t], np.hstack([d_z, d_r, d_new]))
                d_h = d_h * z + to_h @ p[f"h{d}"].T
            g |= {f"x{d}": x.T @ d_gates, f"c{d}": d_gates.sum(axis=0)}
            d_x += d_gates @ p[f"x{d}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], w.word[used], d_x[:, :DIM])
        n = (w.ends[1:] - w.ends[:-1])[used]
        np.add.at(g["char"], w.grams[ranges(w.ends[:-1][used], n)], np.repeat(d_x[:, DIM:] / n[:, None], n, axis=0))
        return g


@dataclass
class Adam:
    rate: float
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)
    step: int = 0

    def update(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] = (params[k] - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
