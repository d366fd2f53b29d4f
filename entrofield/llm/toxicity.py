"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, trained in numpy.

Input of a word: an embedding (words of the training sample's vocabulary; all others share one) and the mean embedding of its hashed character trigrams. Two gated
recurrent layers read a window of WINDOW words in both directions; attention pools their states to one logit per window. All overlapping windows, one at
every word, of the whole text are scored; the document's score is its highest logit, calibrated to a probability by logistic regression.

Training: on the driver, on at most SAMPLE labelled documents taken in the order of a hash of their id (fewer if there are fewer), on all their windows (all are scored every second epoch to find the best). First
embedding coordinates start at the words' and trigrams' log-odds in the sample. The loss is the cross-entropy of a document's best window. One text and its near
copies (a Jaccard index of COPY over the whole texts' shingles) of a label count once.

Null and empty texts are one empty window. Labels with null, and of documents that are missing, are ignored; a document with several labels counts as toxic if one
of them says so. Without labels of both kinds every score is 0. Repeated rows get equal scores. An empty table gives no rows. Other columns are kept by
reject() and ignored by score().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, key_hash, map_whole, slices
from .shingles import shingles

WORD = re.compile(r"[^\W\d_]+")
WINDOW = 24
SAMPLE = 4000
VOCABULARY, TRIGRAMS = 4000, 4096
DIM, HIDDEN, ATT = 8, 12, 8
EPOCHS, MOST_EPOCHS, LEAST_STEPS = 4, 16, 120
#: Epochs after which all windows are scored again to find each document's best one.
REFRESH = 2
BATCH, RATE, DECAY = 64, 0.01, 0.01
#: Jaccard index of whole texts from which one is a copy of the other.
COPY = 0.75
#: Standard errors from which a word counts as telling at the start.
TELLING = 2.6
#: Weight of the calibration slope's prior.
PRIOR = 5.0
#: Windows scored at once, and words of a worker's memo.
CHUNK, MEMO = 1536, 60_000
#: Most rows, and bytes unless one row has more, that are scored at once: the arrays of a slice take some 50 bytes a word.
ROWS, SLICE = 128, 1 << 19


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def trigram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of ^word$ for all words in turn, and where each word's begin. Every word has one at least."""
    s = "^" + "$^".join(words) + "$"
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = (cp[:-2] * np.uint32(0x9E3779B1)) ^ (cp[1:-1] * np.uint32(0x85EBCA77)) ^ (cp[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(TRIGRAMS)
    n = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(n)
    keep = np.ones(len(h), bool)
    cut = ends[:-1]
    keep[cut - 2] = keep[cut - 1] = False  # trigrams over two words
    return h[keep].astype(np.int64), np.concatenate([[0], np.cumsum(n - 2)[:-1]])


def layout(n_words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents side by side, each of WINDOW places at least: the word (of all documents' words in turn, -1 for none) at each place, each document's first place, and
    at which places a window starts: one at every word that has a whole window after it, one for a shorter document.
    """
    n = np.array(n_words, np.int64)
    room = np.maximum(n, WINDOW)
    first = np.cumsum(room) - room
    doc = np.repeat(np.arange(len(n)), room)
    within = np.arange(room.sum()) - first[doc]
    word = np.where(within < n[doc], (np.cumsum(n) - n)[doc] + within, -1)
    return word, first, within + WINDOW <= room[doc]


# ---------------------------------------------------------------- network


def gru(pre: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent layer over time-major pre-activations (T, B, 3H); keep collects what the backward pass needs."""
    h = np.zeros((pre.shape[1], HIDDEN), np.float32)
    out = np.empty((*pre.shape[:2], HIDDEN), np.float32)
    for t in range(len(pre)):
        hu = h @ u
        zr = sigmoid(pre[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        n = np.tanh(pre[t, :, 2 * HIDDEN :] + r * un)
        if keep is not None:
            keep.append((h, z, r, n, un))
        h = n + z * (h - n)
        out[t] = h
    return out


def gru_back(dout: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of pre-activations and recurrent weights."""
    dpre, du, dh = np.empty((*dout.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros_like(dout[0])
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dpre[t] = np.concatenate([dz, dr, dn], 1)
        d = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ d
        dh = dh * z + d @ u.T
    return dpre, du


class Numbers(dict):
    """Words by number, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Network:
    """Parameters and both passes. p: name -> array."""

    def __init__(self, vocabulary: list[str], p: dict[str, np.ndarray], scale: tuple[float, float] = (1.0, 0.0)):
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.vocabulary, self.p, self.scale = vocabulary, p, scale
        self.memo = Numbers()
        self.rows = np.eye(2 * DIM + 2, dtype=np.float32)[-1:]

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        wid = np.array([self.ids.get(w, 0) for w in words])
        tri, start = trigram_ids(words)
        n = np.diff(np.append(start, len(tri)))[:, None]
        x = np.concatenate([self.p["word"][wid], np.add.reduceat(self.p["char"][tri], start, axis=0) / n], 1)
        return x, (wid, tri, n[:, 0])

    def pad_row(self) -> np.ndarray:
        """Pre-activations that leave the state as it is: the update gate is closed."""
        row = np.zeros(6 * HIDDEN, np.float32)
        row[:HIDDEN] = row[3 * HIDDEN : 4 * HIDDEN] = 60.0
        return row

    def forward(self, pre: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; at (windows, WINDOW) are rows of pre, whose last row is the padding's."""
        p, real = self.p, at != len(pre) - 1
        back: list | None = [] if keep is not None else None
        ahead: list | None = [] if keep is not None else None
        g = pre[at.T]  # time first
        hf = gru(g[:, :, : 3 * HIDDEN], p["uf"], ahead)
        hb = gru(g[::-1, :, 3 * HIDDEN :], p["ub"], back)[::-1]
        h = np.concatenate([hf, hb], 2)
        a = np.tanh(h @ p["att"])
        s = np.where(real.T, a @ p["v"], -1e9)
        e = np.exp(s - s.max(0)) * real.T
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = (alpha[:, :, None] * h).sum(0)
        if keep is not None:
            keep.update(ahead=ahead, back=back, h=h, a=a, alpha=alpha, pooled=pooled)
        return pooled @ p["w"] + p["b"][0]

    def slide(self, pre: np.ndarray, at: np.ndarray) -> np.ndarray:
        """forward() of the windows at all places of at, which holds rows of pre (the padding's last): logits of len(at) - WINDOW + 1 windows. pre: pre-activations, or
        entries like those of self.rows, which take a fourth of the room and are projected chunk by chunk.

        States are feature-major, and neighbouring windows are neighbouring columns, so that a step of all windows reads one slice. Weights of the gates are halved
        beforehand, since sigmoid(x) = (1 + tanh(x / 2)) / 2. Of the forward states only what attention reads is kept (their shares of its ATT features and of the
        pooled product), the backward states add theirs to it. Steps work in place, in buffers that all chunks share: their speed is that of the cache.
        """
        p, n_at = self.p, len(at) - WINDOW + 1
        gate = np.full((3 * HIDDEN, 1), 0.5, np.float32)
        uf, ub = (np.ascontiguousarray(p[u].T) * gate for u in ("uf", "ub"))
        gate[2 * HIDDEN :] = 1.0
        project = np.eye(6 * HIDDEN, dtype=np.float32) if pre.shape[1] == 6 * HIDDEN else np.concatenate([p["wx"].T, p["bx"][:, None], self.pad_row()[:, None]], 1)
        project, out = project * np.concatenate([gate, gate]), np.empty(n_at, np.float32)
        read_f, read_b = (np.concatenate([p["att"][i : i + HIDDEN].T, p["w"][None, i : i + HIDDEN]]) for i in (0, HIDDEN))
        half, one, most = np.float32(0.5), np.float32(1), min(CHUNK, n_at)
        gathered, x_room = np.empty((most + WINDOW - 1, pre.shape[1]), np.float32), np.empty(6 * HIDDEN * (most + WINDOW - 1), np.float32)
        heights = (WINDOW * (ATT + 1), WINDOW, ATT + 1, 3 * HIDDEN, HIDDEN)
        rooms = [np.empty(n * most, np.float32) for n in heights]
        for i in range(0, n_at, CHUNK):
            k = min(CHUNK, n_at - i)
            rows = at[i : i + k + WINDOW - 1]
            np.take(pre, rows, axis=0, out=gathered[: len(rows)], mode="clip")
            x = x_room[: 6 * HIDDEN * len(rows)].reshape(6 * HIDDEN, len(rows))
            np.dot(project, gathered[: len(rows)].T, x)
            seen, s, own, g, h = (room[: n * k].reshape(n, k) for room, n in zip(rooms, heights))
            seen, gates, z, r, n = seen.reshape(WINDOW, ATT + 1, k), g[: 2 * HIDDEN], g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN :]
            for u, read, base, order in ((uf, read_f, 0, range(WINDOW)), (ub, read_b, 3 * HIDDEN, range(WINDOW - 1, -1, -1))):
                x_gates, x_n = x[base : base + 2 * HIDDEN], x[base + 2 * HIDDEN : base + 3 * HIDDEN]
                for t in order:
                    if t == order[0]:  # from the state 0: h = (1 - z) * n
                        np.tanh(x_gates[:HIDDEN, t : t + k], z)
                        np.tanh(x_n[:, t : t + k], n)
                        np.multiply(z, n, h)
                        np.subtract(n, h, h)
                        np.multiply(h, half, h)
                    else:
                        np.dot(u, h, g)
                        np.add(gates, x_gates[:, t : t + k], gates)
                        np.tanh(gates, gates)
                        np.add(gates, one, gates)
                        np.multiply(n, r, n)
                        np.add(n, x_n[:, t : t + k], n)
                        np.tanh(n, n)
                        np.subtract(h, n, h)
                        np.multiply(h, z, h)
                        np.multiply(h, half, h)
                        np.add(h, n, h)
                    if not base:
                        np.dot(read, h, seen[t])
                    else:
                        np.dot(read, h, own)
                        np.add(seen[t], own, seen[t])
                        a = seen[t, :ATT]
                        np.tanh(a, a)
                        np.dot(p["v"], a, s[t])
            real = rows != len(pre) - 1
            padded = None if real.all() else ~np.lib.stride_tricks.sliding_window_view(real, k)
            if padded is not None:
                s[padded] = -1e9
            s -= s.max(0)
            np.exp(s, s)
            if padded is not None:
                s[padded] = 0
            out[i : i + k] = np.einsum("tk,tk->k", s, seen[:, ATT]) / np.maximum(s.sum(0), 1e-9) + p["b"][0]
        return out

    def backward(self, dlogit: np.ndarray, k: dict) -> tuple[dict, np.ndarray]:
        p, h, a, alpha = self.p, k["h"], k["a"], k["alpha"]
        g = {"w": k["pooled"].T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["w"]
        dh = alpha[:, :, None] * dpool
        dal = (h * dpool).sum(2)
        ds = alpha * (dal - (alpha * dal).sum(0))
        g["v"] = (a * ds[:, :, None]).sum((0, 1))
        da = ds[:, :, None] * p["v"] * (1 - a * a)
        g["att"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATT)
        dh = dh + da @ p["att"].T
        df, g["uf"] = gru_back(dh[:, :, :HIDDEN], p["uf"], k["ahead"])
        db, g["ub"] = gru_back(dh[::-1, :, HIDDEN:], p["ub"], k["back"])
        return g, np.concatenate([df, db[::-1]], 2)

    # ---- scoring

    def rows_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows in self.rows of the entries of each text's words: their input and 1, 0; the last row is the padding's: 0, ..., 0, 1."""
        if len(self.memo) > MEMO:
            self.memo, self.rows = Numbers(), self.rows[-1:].copy()
        known = len(self.memo)
        out = [np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
        if len(self.memo) >= len(self.rows):
            rows = np.empty((max(2 * len(self.rows), len(self.memo) + 1), 2 * DIM + 2), np.float32)
            rows[:known], rows[-1] = self.rows[:known], self.rows[-1]
            self.rows = rows
        new = list(islice(self.memo, known, None))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            at = self.rows[known + i : known + i + len(part)]
            at[:, : 2 * DIM], at[:, 2 * DIM :] = self.inputs(part)[0], (1, 0)
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Highest window logit of each text."""
        rows = self.rows_of(texts)
        word, first, starts = layout([len(r) for r in rows])
        pad = np.array([len(self.rows) - 1])  # -1 in word
        return np.maximum.reduceat(windows(self, self.rows, np.concatenate([*rows, pad])[word], starts), first)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.logits(texts).astype(np.float64) + b)


# ---------------------------------------------------------------- training


def odds(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """Log-odds of presence in toxic against other documents, in standard errors."""
    lift = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    return lift / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))


def distinct(docs: list[list[str]], y: list[int]) -> tuple[list[list[str]], np.ndarray]:
    """The first of each group of copies: of documents of one label whose whole texts have COPY of their shingles in common.

    Such texts share one of their rarest shingles at least, so each document meets only the kept ones that do.
    """
    sets = [shingles(" ".join(w)) for w in docs]
    kinds, df = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, int))
    by_rare: dict[tuple, list[int]] = {}
    at = []
    for i, s in enumerate(sets):
        n = df[np.searchsorted(kinds, s)]
        first = np.lexsort((s, n))[: len(s) - math.ceil(COPY * len(s)) + 1]
        rarest = s[first][n[first] > 1].tolist() if len(s) else [-1]  # nobody is met by what one document has
        met = {j for r in rarest for j in by_rare.get((r, y[i]), ())}
        if any(_copies(s, sets[j]) for j in met):
            continue
        at.append(i)
        for r in rarest:
            by_rare.setdefault((r, y[i]), []).append(i)
    return [docs[i] for i in at], np.array([y[i] for i in at])


def _copies(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < COPY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= COPY * (len(a) + len(b) - both)


def start(docs: list[list[str]], y: np.ndarray, rng: np.random.Generator) -> tuple[Network, dict[str, float]]:
    n_yes, n_no = int(y.sum()), int((1 - y).sum())
    yes, no = Counter(), Counter()
    for w, t in zip(docs, y):
        (yes if t else no).update(set(w))
    known = [w for w in yes.keys() | no.keys() if yes[w] + no[w] >= 3]
    known.sort()
    z = odds(np.array([yes[w] for w in known], float), np.array([no[w] for w in known], float), n_yes, n_no)
    order = np.argsort(-np.abs(z), kind="stable")[:VOCABULARY]
    vocabulary, z = [known[i] for i in order], z[order]
    telling = dict(zip(vocabulary, z.tolist()))
    tri = np.zeros((2, TRIGRAMS))
    for w, t in zip(docs, y):
        if w:
            tri[int(t), np.unique(trigram_ids(sorted(set(w)))[0])] += 1
    zc = odds(tri[1], tri[0], n_yes, n_no)

    def normal(*shape: int, sd: float) -> np.ndarray:
        return (rng.standard_normal(shape) * sd).astype(np.float32)

    p = {"word": normal(len(vocabulary) + 1, DIM, sd=0.05), "char": normal(TRIGRAMS, DIM, sd=0.05), "wx": normal(2 * DIM, 6 * HIDDEN, sd=0.3), "bx": np.zeros(6 * HIDDEN, np.float32)}
    p |= {"uf": normal(HIDDEN, 3 * HIDDEN, sd=0.2), "ub": normal(HIDDEN, 3 * HIDDEN, sd=0.2), "att": normal(2 * HIDDEN, ATT, sd=0.3), "v": normal(ATT, sd=0.3), "w": normal(2 * HIDDEN, sd=0.3), "b": np.array([-2.0], np.float32)}
    p["word"][1:, 0] = np.where(z >= TELLING, np.minimum(z / 2, 3), 0)
    p["word"][0, 0] = 0
    p["char"][:, 0] = np.clip(zc / 10, -0.5, 1)
    return Network(vocabulary, p), telling


def windows(net: Network, pre: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Logit of the window at each place, minus infinity where none starts."""
    out = np.full(len(at), -np.inf, np.float32)
    got = net.slide(pre, at)
    out[: len(got)] = np.where(starts[: len(got)], got, -np.inf)
    return out


def best_windows(net: Network, pre: np.ndarray, own: np.ndarray, n_words: list[int]) -> np.ndarray:
    """Rows of pre in the window with the highest logit (the first among equals) of each document, of all its windows. own: the words' rows; the last row of pre is the padding's."""
    word, first, starts = layout(n_words)
    at = np.append(own, len(pre) - 1)[word]
    logit = windows(net, pre, at, starts)
    best = np.array([a + np.argmax(logit[a:b]) for a, b in zip(first, np.append(first[1:], len(at)))])
    return at[best[:, None] + np.arange(WINDOW)]


def scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by their place in a table of n rows."""
    out, order = np.zeros((n, values.shape[1]), np.float32), np.argsort(at, kind="stable")
    places, start = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(values[order], start, axis=0)
    return out


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Network | None:
    """Fits the network on three quarters of the documents and calibrates it on the rest. None without documents of both kinds."""
    rng = np.random.default_rng(seed)
    once: dict[str, str] = {}  # one string per word, not per occurrence
    docs, y = distinct([[once.setdefault(w, w) for w in words_of(t)] for t in texts], labels)
    if y.sum() < 2 or (1 - y).sum() < 2:
        return None
    calib = np.zeros(len(docs), bool)
    for kind in (0, 1):  # a fourth of each kind, none of a kind with few
        of = rng.permutation(np.flatnonzero(y == kind))
        calib[of[: len(of) // 4]] = True
    fit = np.flatnonzero(~calib)
    net = start([docs[i] for i in fit], y[fit], rng)[0]
    unique = sorted({w for d in docs for w in d}) or ["-"]
    number = {w: k for k, w in enumerate(unique)}
    numbers = [np.array([number[w] for w in d], np.int32) for d in docs]
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-LEAST_STEPS * BATCH // len(fit))))
    best: dict[int, list[str]] = {}
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            if epoch % REFRESH == 0:
                used, own = np.unique(np.concatenate([numbers[d] for d in part]), return_inverse=True)
                words = [unique[k] for k in used] or ["-"]
                pre = np.concatenate([net.inputs(words)[0] @ net.p["wx"] + net.p["bx"], net.pad_row()[None]]).astype(np.float32)
                for d, row in zip(part.tolist(), best_windows(net, pre, own, [len(numbers[d]) for d in part])):
                    best[d] = [words[k] for k in row if k < len(words)]
            words = sorted({w for d in part for w in best[d]}) or ["-"]
            at_word = {w: k for k, w in enumerate(words)}
            at = np.full((len(part), WINDOW), len(words))
            for row, d in zip(at, part.tolist()):
                row[: len(best[d])] = [at_word[w] for w in best[d]]
            x, (wid, tri, n_tri) = net.inputs(words)
            pre = np.concatenate([x @ net.p["wx"] + net.p["bx"], net.pad_row()[None]]).astype(np.float32)
            kept: dict = {}
            dlogit = (sigmoid(net.forward(pre, at, kept)) - y[part]).astype(np.float32) / len(part)
            g, dpre = net.backward(dlogit, kept)
            flat_pre = scatter(at.T.ravel(), dpre.reshape(-1, 6 * HIDDEN), len(pre))[:-1]
            g["wx"], g["bx"] = x.T @ flat_pre, flat_pre.sum(0)
            dx = flat_pre @ net.p["wx"].T
            g["word"] = scatter(wid, dx[:, :DIM], len(net.p["word"]))
            g["char"] = scatter(tri, np.repeat(dx[:, DIM:] / n_tri[:, None], n_tri, axis=0), TRIGRAMS)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for k in ("word", "char"):  # what the start hasn't found telling must earn its place
                net.p[k][:, 1:] *= 1 - DECAY
    held = np.flatnonzero(calib) if y[calib].sum() >= 3 else np.arange(len(docs))
    x = np.concatenate([net.logits([" ".join(docs[d]) for d in held[i : i + 128]]) for i in range(0, len(held), 128)]).astype(np.float64)
    net.scale = calibrate(x, y[held])
    return net


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the highest logit by Newton's method; the slope is drawn to 1, which only matters with few documents."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * x + b)
        w = q * (1 - q) + 1e-6
        ga, gb = ((q - y) * x).sum() + PRIOR * (a - 1), (q - y).sum()
        haa, hab, hbb = (w * x * x).sum() + PRIOR, (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    return max(a, 1e-3), b


# ---------------------------------------------------------------- on Spark


def learn(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Network | None:
    """Trains on at most `sample` labelled documents whose `training` condition on doc_id holds."""
    ids = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = ids.orderBy(key_hash("doc_id", seed=3), "doc_id").limit(sample)  # at most `sample` ids: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.toArrow().sort_by("doc_id")
    return train(rows.column("text").to_pylist(), [int(t > 0) for t in rows.column("toxic").to_pylist()])


@lru_cache(maxsize=1)
def _memo(key: bytes) -> Network:
    import pickle

    return Network(*pickle.loads(key))


def _packed(net: Network | None) -> bytes | None:
    import pickle

    return net and pickle.dumps((net.vocabulary, net.p, net.scale))


def _scores(texts: list[str | None], packed: bytes | None) -> np.ndarray:
    return _memo(packed).probabilities(texts) if packed else np.zeros(len(texts))


def _score(batches: Iterator[pa.RecordBatch], packed: bytes | None) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, ROWS, SLICE):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1).to_pylist(), packed), pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    bounded_batches(docs.sparkSession)
    packed = _packed(net)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, packed), "doc_id long, score double")


def _reject(batches: Iterator[pa.RecordBatch], at: int, packed: bytes | None, limit: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, ROWS, SLICE):
        yield b.filter(pa.array(_scores(b.column(at).to_pylist(), packed) < limit))


def reject(docs: DataFrame, net: Network | None, limit: float = 0.5) -> DataFrame:
    """docs without those that score limit or more."""
    bounded_batches(docs.sparkSession)
    packed, at = _packed(net), docs.columns.index("text")
    return map_whole(docs, lambda it: _reject(it, at, packed, limit))
