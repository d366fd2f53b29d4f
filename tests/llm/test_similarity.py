import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from entrofield.llm import fingerprint as FP
from entrofield.llm import jaccard_join as J
from entrofield.llm.shingles import shingles


def word_set(text):
    """Shingles as tuples of words."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """rows: (id, text). All pairs, then union-find; a component's id is its smallest id that isn't null."""
    sets = [word_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and sets[k] and 100 * both >= 75 * (len(sets[i]) + len(sets[k]) - both):
                top[find(i)] = find(k)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def test_shingles_count(texts):
    for t in [*texts, "", None, " ", "A b\tC"]:
        assert len(shingles(t)) == len(word_set(t))
    assert (shingles("One two\nthree four FIVE six") == shingles("one  two three four five six")).all()


def compare(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = Counter((i, t, *x) for (i, t), x in zip(rows, brute_components(rows)))
    got = J.jaccard_components(df)
    assert Counter((i, *x) for (i, _), x in zip(rows, brute_components(rows))) == Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    return want


def test_components_equal_brute_force(docs):
    compare(docs)


def test_near_copies_of_many_kinds(spark, words):
    """Clusters whose members link only through others, and many texts around one passage."""
    rng = random.Random(9)
    rows, base = [], [rng.choice(words) for _ in range(100)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(100)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    chain = [rng.choice(words) for _ in range(160)]
    rows += [(1000 + i, " ".join(chain[i * 4 : i * 4 + 60])) for i in range(25)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(60)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_frequent_shingles_bypass_the_buckets(spark, words, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 3)
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(40)]
    rows = [(i, " ".join(base[: rng.randint(25, 40)])) for i in range(40)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_filters_lose_nothing():
    """Any two sets of similarity 3/4 or more share enough of their first elements, in cores and prefixes."""
    rng = random.Random(4)
    for _ in range(4000):
        n = rng.randint(1, 60)
        common, a, b = rng.randint(0, n), rng.randint(0, n // 3), rng.randint(0, n // 3)
        pool = rng.sample(range(500), common + a + b)
        x, y = sorted(pool[: common + a]), sorted(pool[:common] + pool[common + a :])
        if not x or not y or 4 * common < 3 * len(set(x) | set(y)):
            continue
        if len(x) > len(y):
            x, y = y, x
        px, py = x[: J.prefix_length(len(x))], y[: J.prefix_length(len(y))]
        assert set(px) & set(py)
        qx = x[: J.core_length(len(x))]
        qy = y[: J.core_length(len(y))] if len(x) == len(y) else py
        assert set(qx) & set(qy)
        need = -(-3 * (len(x) + len(y)) // 7)
        assert len(set(px) & set(py)) >= need - max(len(x) - len(px), len(y) - len(py))
        assert len(set(qx) & set(qy)) >= need - max(len(x) - len(qx), len(y) - len(qy))


def test_pivots_lose_nothing(spark, words, monkeypatch):
    """Every list with a set outside its largest component goes through pivots; families whose members' edits leave them close to the limit."""
    monkeypatch.setattr(J, "FEW", 0)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rng = random.Random(12)
    rows = []
    for family in range(3):
        base = [rng.choice(words) for _ in range(90)]
        for i in range(70):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 3))]
            rows.append((family * 1000 + i, " ".join(copy)))
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_differences_suffice():
    """Of sets x, y and a pivot: if x and y link and x isn't linked to the pivot, the first elements of their differences have one in common from which on enough are left."""
    rng, tried = random.Random(8), 0
    for _ in range(30_000):
        base = set(range(rng.randint(3, 40)))
        def edit(s, k):
            s = set(s)
            for _ in range(rng.randint(0, k)):
                s.discard(rng.choice(sorted(s))) if len(s) > 1 and rng.random() < 0.5 else s.add(rng.randrange(60))
            return s
        p = edit(base, 6)
        x = edit(base, 12)
        y = edit(x, 8)
        link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
        if not link(x, y) or link(x, p) or y == p or x == p:
            continue
        tried += 1
        lists = []
        for s in (x, y):
            far, first = J.first_differences(len(s), len(p), len(s & p))
            d = sorted(s ^ p, key=lambda v: (v * 7919 % 61, v))
            assert far == link(s, p) and 0 < first <= len(d)
            lists.append({v: len(d) - i for i, v in enumerate(d[:first])})
        a, b = len(x ^ p), len(y ^ p)
        assert any(14 * min(lists[0][v], lists[1][v]) >= 7 * (a + b) - len(x) - len(y) for v in lists[0].keys() & lists[1].keys())
    assert tried > 1000


def test_long_words_are_digested():
    a, b = "x" * 5000 + " b c d e", "x" * 4999 + "y b c d e"
    assert len(shingles(a)) == 1 and shingles(a) != shingles(b) and (shingles(a) == shingles(a.upper())).all()


def kept_rows(rows):
    """Brute force: the rows that stay, by (doc_id, text); of equal ones how many."""
    groups = {}
    parts = brute_components(rows)
    sets = [word_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if sets[i] and sets[k] and 100 * both >= 75 * (len(sets[i]) + len(sets[k]) - both):
                top[find(i)] = find(k)
    for i, ((doc, text), (n, _)) in enumerate(zip(rows, parts)):
        if n:
            groups.setdefault(find(i), []).append((doc is None, doc or 0))
    return [min(g) for g in groups.values()], Counter((d, t) for (d, t), (n, _) in zip(rows, parts) if not n)


def test_keep_one(docs, empty):
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    ids, blank = kept_rows(rows)
    assert Counter((d is None, d or 0) for d, t in got if word_set(t)) == Counter(ids)
    assert Counter((d, t) for d, t in got if not word_set(t)) == blank
    assert J.keep_one(empty).count() == 0 and J.jaccard_components(empty).count() == 0


def test_keep_one_by_row(spark, monkeypatch):
    """Rows that share an id are told apart by their texts; exact copies go."""
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text of more words"), (7, "third text with its own words"), (7, "third text with its own words"), (None, "no id but words of its own"), (None, "no id but words of its own"), (None, "a b c d e f"), (None, ""), (None, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, `class` int").repartition(4)
    for limit in (J.BROADCAST_IDS, 0):
        monkeypatch.setattr(J, "BROADCAST_IDS", limit)
        got = Counter((r.doc_id, r.text) for r in J.keep_one(df).collect())
        assert got == Counter({rows[0]: 1, rows[2]: 1, rows[3]: 1, rows[5]: 1, (None, ""): 2})


# ---------------------------------------------------------------- fingerprints


def generalised(a, b):
    a, b = Counter((a or "").lower().split()), Counter((b or "").lower().split())
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_collision_rate_is_generalised_jaccard(spark):
    """With many samples the share of equal ones meets the weighted similarity."""
    pairs = [("a a a b c", "a b b d"), ("x y z " * 5, "x y z"), ("p q r s t", "p q r s u"), ("m", "n")]
    rows = [(i, i, i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "doc_id long, uid long, next_id long, text string, edited_text string")
    got = FP.signatures(df.repartition("doc_id"), samples=400)
    for r in got.select("doc_id", FP.likeness(F.col("own"), F.col("other")).alias("v")).collect():
        assert r.v == pytest.approx(generalised(*pairs[r.doc_id]), abs=0.09)


def chained(*parts):
    """Spark's xxhash64 of an int and longs, or of a string, signed."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<q" if isinstance(x, np.int64) else "<i", x), seed=seed).intdigest()
    return np.uint64(seed).astype(np.int64)


def plain_samples(text, n):
    """Consistent weighted samples by their definition, one term after another; None without words."""
    words = Counter(w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w)
    out = []
    for k in range(n):
        best = None
        for word, count in words.items():
            term = chained(word)
            h, g = int(chained(2 * k, term)) % 2**64, int(chained(2 * k + 1, term)) % 2**64
            u = lambda v: ((v & 0xFFFFFF) + 0.5) / 2**24
            r, c, b = -math.log(u(h) * u(h >> 24)), -math.log(u(g) * u(g >> 24)), u(h >> 40)
            level = math.floor(math.log(count) / r + b)
            value = math.log(c) + r * (b - 1 - level)
            if best is None or value < best[0]:
                best = value, word, level
        out.append(best and best[1:])
    return out


@pytest.mark.parametrize("limit", [FP.BROADCAST_ROWS, 0])
def test_report_equals_brute_force(docs, empty, limit, monkeypatch):
    """Every row: the edit, and both likenesses as the exact share of equal samples; neighbours sent to the tasks or joined."""
    monkeypatch.setattr(FP, "BROADCAST_ROWS", limit)
    short = docs.where("text is null or length(text) < 4000")
    got = FP.fingerprint_report(short).toPandas()
    rows = [(r.doc_id, r.text or "") for r in short.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    ids = sorted({i for i, _ in rows if i is not None})
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    memo = {}
    samples = lambda t: memo.setdefault(t, plain_samples(t, FP.SAMPLES))
    like = lambda a, b: sum(x == y for x, y in zip(samples(a), samples(b))) / FP.SAMPLES
    want = {}
    for i, t in rows:
        for n in {u for j, u in rows if j == after[i]} if i is not None else {""}:  # ids with several rows have several first rows to choose from
            new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            want.setdefault((i, len(t), hashlib.sha256(new.encode()).hexdigest()), []).append((like(t, new), like(t, n)))
    for r in got.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256
        assert any(r.near_edited == pytest.approx(a) and r.near_next == pytest.approx(b) for a, b in want[key]), key
    assert len(want) >= len(rows) - 10 and FP.fingerprint_report(empty).count() == 0


@pytest.mark.parametrize("block", [FP.BLOCK, 40])
def test_next_ids_of_any_distribution(spark, block, monkeypatch, tmp_path):
    monkeypatch.setattr(FP, "BLOCK", block)
    rng = random.Random(1)
    for ids in ([5], sorted({rng.randrange(-(2**63), 2**63) for _ in range(700)}), sorted([*rng.sample(range(-(10**9), 10**9), 300), *range(100), 2**62, -(2**62)])):
        got = {r.doc_id: r.next_id for r in FP.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long"), str(tmp_path / f"{len(ids)}")).collect()}
        assert got == dict(zip(ids, [*ids[1:], ids[0]]))


def test_equal_texts_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "b a c a"), (5, "b a c a"), (9, None), (12, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in FP.fingerprint_report(df).collect()}
    assert got[1].fingerprint == got[5].fingerprint and got[1].near_next == 1.0
    assert got[9].fingerprint == got[12].fingerprint and got[9].near_next == 1.0 and got[5].near_next == 0.0
