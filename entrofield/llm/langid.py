"""Language identification by mixture inference: each document's language proportions, and the set of languages it is written in.

Likelihoods: one character model per language, p(c | two characters before) from trigram counts with smoothing towards bigrams and unigrams, over characters
folded into CODES classes (letters lower-cased; rare characters share classes by hash). A word's likelihood under a language is the product over its
characters and the blank after it. The counts cover every training document; they are dense arrays of a fixed size, added up on the executors.

Inference: each word of a document comes from one of its languages. Expectation-maximisation finds the proportions that make the words likeliest, for all
documents of a batch at once. Languages leave one by one, the least frequent first, and the set with the best log-likelihood less PENALTY * log(words) per language
beyond the first stays. The prediction is the language with the largest proportion in that set; the score is this proportion.

Null texts and texts without a letter are `und` with score 0. Languages are the labels seen in training, in order; null labels aren't learned from. Without any
training document everything is `und`. Repeated rows are judged alike and count as often as they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

CODES = 64
#: A word is a run of letters; everything else separates.
LETTERS = re.compile(r"[^\W\d_]+")
PENALTY = 2.0
ITERATIONS = 25
#: Words of a worker's memo.
MEMO = 200_000
BETA = 8.0


def classes(text: str) -> np.ndarray:
    """Character classes of a lower-cased text: 0 blank, 1-26 a-z, others by a fixed hash of the code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    az = (cp >= 97) & (cp <= 122)
    other = 27 + (cp * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(CODES - 27)
    return np.where(cp == 32, 0, np.where(az, cp - 96, other)).astype(np.int64)


def trigrams(text: str) -> np.ndarray:
    """Numbers of all trigrams of the words of a text, each word between blanks."""
    s = classes("  " + "  ".join(LETTERS.findall(text.lower())) + " ")
    g = (s[:-2] * CODES + s[1:-1]) * CODES + s[2:]
    return g[(s[1:-1] != 0) | (s[2:] != 0)]  # not those that only join two words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(text or "")
        for lang, texts in by.items():
            n = np.bincount(trigrams("\n".join(texts)), minlength=CODES**3)  # words don't run over the joints
            counts[lang] = counts[lang] + n if lang in counts else n.astype(np.int64)
    for lang, n in counts.items():  # sparse: one row per trigram seen
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])


class Models:
    """log p(c | two before) of each language, as a (languages, CODES ** 3) array."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        c3 = counts.reshape(len(langs), CODES, CODES, CODES).astype(np.float64)
        c2, c1 = c3.sum(1), c3.sum((1, 2))
        p1 = (c1 + 0.5) / (c1.sum(1, keepdims=True) + 0.5 * CODES)
        p2 = (c2 + BETA * p1[:, None, :]) / (c2.sum(2, keepdims=True) + BETA)
        p3 = (c3 + BETA * p2[:, None, :, :]) / (c3.sum(3, keepdims=True) + BETA)
        self.logp = np.log(p3).reshape(len(langs), CODES**3).astype(np.float32)
        self.memo: dict[str, int] = {}
        self.rows = np.empty((1024, len(langs)), np.float32)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Row numbers in self.rows of the words' log-likelihoods per language."""
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.int64)
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in memo]
        s = classes("  " + "  ".join(new) + " ")
        g = (s[:-2] * CODES + s[1:-1]) * CODES + s[2:]
        start = np.flatnonzero(np.concatenate([[True], (s[1:-2] == 0) & (s[2:-1] == 0)])) if new else np.zeros(0, np.int64)
        ll = self.logp[:, g]
        ll[:, (s[1:-1] == 0) & (s[2:] == 0)] = 0
        sums = np.add.reduceat(ll, start, axis=1).T
        base = len(memo)
        while base + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[base : base + len(new)] = sums
        memo.update(zip(new, range(base, base + len(new))))
        return np.array([memo[w] for w in words], np.int64)

    def forget(self) -> None:
        if len(self.memo) > MEMO:
            self.memo, self.rows = {}, np.empty((1024, len(self.langs)), np.float32)


def mixture(lik: np.ndarray, n: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: lik (words, languages) scaled likelihoods, n counts, start first word of each document, allowed (documents, languages).
    Gives proportions and log-likelihoods (less the scaling)."""
    doc = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(n))))
    total = np.add.reduceat(n, start)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ITERATIONS):
        w = lik * pi[doc]
        w *= (n / np.maximum(w.sum(1), 1e-30))[:, None]
        new = np.add.reduceat(w, start, axis=0) / total[:, None]
        if np.abs(new - pi).max() < 1e-3:
            pi = new
            break
        pi = new
    return pi, np.add.reduceat(n * np.log(np.maximum((lik * pi[doc]).sum(1), 1e-30)), start)


def select(lik: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Proportions in the selected set of each document."""
    n_langs = lik.shape[1]
    allowed = np.ones((len(start), n_langs), np.float32)
    words = np.add.reduceat(n, start)
    best, out = np.full(len(start), -np.inf), np.zeros((len(start), n_langs), np.float32)
    for k in range(n_langs, 0, -1):
        pi, ll = mixture(lik, n, start, allowed)
        value = ll - PENALTY * (k - 1) * np.log(1 + words)
        better = value >= best
        best[better], out[better] = value[better], pi[better]
        least = np.where(allowed > 0, pi, np.inf).argmin(1)
        allowed[np.arange(len(start)), least] = 0
    return out


def predict(texts: list[str | None], models: Models) -> tuple[list[str], list[float], list[np.ndarray | None]]:
    models.forget()
    words = [Counter(LETTERS.findall(t.lower())) if t else Counter() for t in texts]
    full = [i for i, w in enumerate(words) if any(c.isalpha() for x in w for c in x)]
    langs, scores, shares = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    if not full or not models.langs:
        return langs, scores, shares
    rows = models.word_rows([w for i in full for w in words[i]])
    ll = models.rows[rows]
    lik = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -30.0))
    n = np.array([c for i in full for c in words[i].values()], np.float32)
    start = np.cumsum([0, *[len(words[i]) for i in full[:-1]]])
    pi = select(lik, n, start)
    for i, p in zip(full, pi):
        k = int(p.argmax())
        langs[i], scores[i], shares[i] = models.langs[k], min(1.0, float(p[k])), p
    return langs, scores, shares


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], counts) -> Iterator[pa.RecordBatch]:
    models = Models(langs, counts.value)
    for b in slices(batches, 256):
        lang, score, share = predict(b.column(1).to_pylist(), models)
        text = ["" if p is None else ",".join(f"{x}:{v:.3f}" for x, v in zip(langs, p) if v > 0) for p in share]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(text, pa.string())], names=["doc_id", "lang_pred", "score", "mixture"])


def learn(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """Languages and trigram counts from text and non-null lang of the training rows; at most CODES ** 3 counts per language reach the driver."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(training & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    n = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(n.column("lang").to_pylist()))
    counts = np.zeros((len(langs), CODES**3), np.int64)
    at = pd.Series(range(len(langs)), langs)
    counts[at[n.column("lang").to_pylist()].to_numpy() if langs else [], n.column("gram").to_numpy()] = n.column("n").to_numpy()
    return langs, counts


def identify(docs: DataFrame, langs: list[str], counts: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, mixture (language:proportion of the selected set) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # CODES ** 3 numbers a language
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, langs, sent), "doc_id long, lang_pred string, score double, mixture string")
