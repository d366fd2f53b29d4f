import numpy as np
import pytest
from pyspark.sql import functions as F

from entrofield.llm import langid as L
from entrofield.llm import toxicity as X
from entrofield.llm.queries import op5_toxicity, op8_language_id, remainder

# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def trained(words):
    rng = np.random.default_rng(1)
    bad = ["vilfoo", "grumbaz", "snorqul"]
    texts, labels = [], []
    for i in range(500):
        w = [words[k] for k in rng.integers(0, len(words), rng.integers(5, 120))]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w) + 1)), bad[int(rng.integers(0, 3))])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return X.train(texts[:400], labels[:400]), texts[400:], labels[400:]


def test_network_learns(trained):
    net, texts, labels = trained
    p = net.probabilities(texts)
    assert ((p >= 0.5) == np.array(labels)).mean() > 0.95


def test_every_window_counts(trained, words):
    net = trained[0]
    clean = " ".join(words[:300] * 10)
    assert net.probabilities([clean])[0] < 0.5
    for at in (0, 1500, 2990):
        w = clean.split()
        w[at : at + 4] = ["vilfoo", "grumbaz", "snorqul", "vilfoo"]
        assert net.probabilities([" ".join(w)])[0] > 0.5


def test_scores_do_not_depend_on_the_batch(trained):
    net, texts, _ = trained
    alone = [float(net.logits([t])[0]) for t in texts[:10]]
    assert np.allclose(alone, net.logits(texts)[:10], atol=1e-4)


def test_gradients():
    """Backward passes against differences."""
    rng = np.random.default_rng(0)
    docs = [["aa", "bb", "cc"], ["dd", "aa", "ee", "ff"]]
    net, _ = X.start(docs, np.array([1, 0]), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    at = np.full((2, X.WINDOW), 6)
    at[0, :3], at[1, :4] = [0, 1, 2], [3, 0, 4, 5]

    def loss():
        x, _ = net.inputs(words)
        pre = np.concatenate([x @ net.p["wx"] + net.p["bx"], net.pad_row()[None]])
        return (net.forward(pre, at) * np.array([1.0, -2.0])).sum()

    x, _ = net.inputs(words)
    pre = np.concatenate([x @ net.p["wx"] + net.p["bx"], net.pad_row()[None]])
    kept = {}
    net.forward(pre, at, kept)
    g, _ = net.backward(np.array([1.0, -2.0]), kept)
    for name in ("uf", "ub", "att", "v", "w"):
        flat = net.p[name].ravel()
        for i in rng.integers(0, flat.size, 4):
            old, eps = flat[i], 1e-2
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert g[name].ravel()[i] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-3), name


def test_windows_overlap_and_cover():
    sizes = [0, 5, 24, 25, 100]
    word, first, starts = X.layout(sizes)
    for k, n in enumerate(sizes):
        own = word[first[k] : first[k + 1] if k < 4 else None]
        base = sum(sizes[:k])
        assert own[own >= 0].tolist() == list(range(base, base + n)) and len(own) == max(n, X.WINDOW)
        begin = starts[first[k] : first[k + 1] if k < 4 else None]
        assert np.flatnonzero(begin).tolist() == list(range(max(1, n - X.WINDOW + 1)))


def plain_score(net, text):
    """The score of a text by loops over windows, words and units."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, H, words = net.p, X.HIDDEN, X.words_of(text)
    best = -np.inf
    for begin in range(max(1, len(words) - X.WINDOW + 1)):
        part = words[begin : begin + X.WINDOW]
        inputs = []
        for w in part:
            tri = X.trigram_ids([w])[0]
            inputs.append(np.concatenate([p["word"][net.ids.get(w, 0)], sum(p["char"][t] for t in tri) / len(tri)]) @ p["wx"] + p["bx"])
        states = [[], []]
        for side, u in enumerate(("uf", "ub")):
            h = np.zeros(H)
            for x in inputs if not side else inputs[::-1]:
                x = x[3 * H * side : 3 * H * (side + 1)]
                hu = h @ p[u]
                z, r = sig(x[:H] + hu[:H]), sig(x[H : 2 * H] + hu[H : 2 * H])
                n = np.tanh(x[2 * H :] + r * hu[2 * H :])
                h = (1 - z) * n + z * h
                states[side].append(h)
        both = [np.concatenate(v) for v in zip(states[0], states[1][::-1])]
        e = [np.exp(np.tanh(h @ p["att"]) @ p["v"]) for h in both]
        pooled = sum((w * h for w, h in zip(e, both)), np.zeros(2 * H)) / max(sum(e), 1e-9)
        best = max(best, pooled @ p["w"] + p["b"][0])
    a, b = net.scale
    return float(sig(a * best + b))


def test_scores_equal_plain_loops(trained):
    net, texts = trained[0], trained[1]
    some = [None, "", "one", "!! 12", *[" ".join(t.split()[:90]) for t in texts[:12]]]
    got = net.probabilities(some)
    assert np.allclose(got, [plain_score(net, t) for t in some], atol=1e-4)


def test_reject_and_odd_rows(spark, trained, docs, empty):
    net = trained[0]
    out = X.reject(docs, net)
    assert out.columns == docs.columns and out.count() >= docs.count() - 3
    assert X.reject(empty, net).count() == 0 and X.score(docs, net).where("score is null").count() == 0
    assert X.score(docs, None).agg(F.max("score")).first()[0] == 0.0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert X.learn(docs, labels, F.lit(True)) is None


def test_held_out_toxicity(spark):
    """On real labels: documents with the learned vocabulary of insults are found in the fold that was not learned from."""
    d = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    n1, n0 = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    assert (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert got.toxic[got.predicted == 1].mean() > 0.85 and got.predicted[got.toxic == 1].mean() > 0.7


# ---------------------------------------------------------------- languages


def brute_mixture(lik, n, iterations=400):
    pi = np.full(lik.shape[1], 1 / lik.shape[1])
    for _ in range(iterations):
        w = lik * pi
        w /= w.sum(1, keepdims=True)
        pi = (w * n[:, None]).sum(0) / n.sum()
    return pi


def test_mixture_equals_long_em():
    rng = np.random.default_rng(2)
    lik, n = rng.random((60, 3)) ** 4, rng.integers(1, 5, 60).astype(np.float32)
    start = np.array([0, 20, 45])
    pi, _ = L.mixture(lik, n, start, np.ones((3, 3), np.float32))
    for k, (a, b) in enumerate(((0, 20), (20, 45), (45, 60))):
        assert np.abs(pi[k] - brute_mixture(lik[a:b], n[a:b])).max() < 0.06


@pytest.fixture(scope="module")
def models():
    english = "the quick brown fox jumps over the lazy dog and then the other foxes went with them through that thin thicket " * 3
    german = "der schnelle braune fuchs springt über den faulen hund und dann gingen die anderen füchse durch das dichte gebüsch " * 3
    counts = np.array([np.bincount(L.trigrams(t), minlength=L.CODES**3) for t in (german, english)])
    return L.Models(["de", "en"], counts)


def test_predicts_and_mixes(models):
    langs, scores, shares = L.predict(["the fox and the dog went", "der hund und die füchse gingen", None, "", "123 ²²!", "the fox and the dog went through the thicket " * 4 + "der hund springt über das gebüsch und die füchse " * 2], models)
    assert langs == ["en", "de", "und", "und", "und", "en"] and scores[2:5] == [0.0] * 3
    assert shares[0][1] == pytest.approx(1, abs=1e-3) and 0.5 < scores[5] < 0.85 and shares[5][0] > 0.15


def test_word_likelihood_is_the_product(models):
    rows = models.word_rows(["fox", "übung", "a"])
    for w, r in zip(["fox", "übung", "a"], rows):
        s = L.classes("  " + w + " ")
        want = sum(models.logp[:, (s[i] * L.CODES + s[i + 1]) * L.CODES + s[i + 2]] for i in range(len(s) - 2))
        assert np.allclose(models.rows[r], want, atol=1e-4)


def test_tables_and_odd_rows(docs, empty):
    langs, counts = L.learn(docs, F.lit(True))
    assert langs == ["de", "en"]
    got = L.identify(docs, langs, counts).toPandas()
    assert len(got) == docs.count() and set(got.lang_pred) <= {"de", "en", "und"} and got.score.between(0, 1).all()
    langs, counts = L.learn(empty, F.lit(True))
    assert langs == [] and set(L.identify(docs, langs, counts).toPandas().lang_pred) == {"und"}
    assert L.identify(empty, langs, counts).count() == 0


def test_held_out_languages(spark, sf):
    d = "/root/testdata/sf0.01"
    got = op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_fold_is_crc32(spark):
    import zlib

    df = spark.range(200).withColumn("r", remainder(F.col("id"), 5))
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in df.collect())
