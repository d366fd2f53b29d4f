"""What the toxicity model is trained on."""

import numpy as np

from entrofield.llm import toxicity as X


def test_only_whole_copies_count_once(words):
    rng = np.random.default_rng(4)
    banner = "welcome to the board of all users".split()
    body = lambda n: [words[k] for k in rng.integers(0, len(words), n)]
    other = [banner + body(80) for _ in range(20)]
    base = body(200)
    near = [[*base[:at], "changed", *base[at + 1 :]] for at in (3, 90, 180)]
    docs = [*other, base, list(base), *near, [], [], ["one", "two"], ["one", "two"], ["one", "three"]]
    got, y = X.distinct(docs, [0] * len(docs))
    assert got == [*other, base, [], ["one", "two"], ["one", "three"]] and len(y) == len(got)
    got, y = X.distinct([base, base, base], [0, 1, 1])
    assert len(got) == 2 and y.tolist() == [0, 1]
    assert X.distinct([], [])[0] == []


def test_copies_equal_brute_force(words):
    """Kept documents are those of a loop over all pairs."""
    rng = np.random.default_rng(8)
    docs = []
    for _ in range(12):
        base = [words[k] for k in rng.integers(0, len(words), 60)]
        for changes in (0, 1, 2, 3, 4):
            copy = list(base)
            for at in rng.integers(0, 60, changes):
                copy[at] = words[rng.integers(0, len(words))]
            docs.append(copy)
    grams = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    kept: list[int] = []
    for i, g in enumerate(grams):
        if all(len(g & grams[j]) < 0.75 * len(g | grams[j]) for j in kept):
            kept.append(i)
    assert X.distinct(docs, [1] * len(docs))[0] == [docs[i] for i in kept]


def test_training_reads_all_windows(words, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [[words[k] for k in rng.integers(0, len(words), 300)] for _ in range(16)]
    seen, windows = [], X.windows
    monkeypatch.setattr(X, "windows", lambda net, pre, at, starts: (seen.append(int(starts.sum())), windows(net, pre, at, starts))[1])
    assert X.train([" ".join(d) for d in docs], [i % 2 for i in range(16)])
    fit = 12  # three quarters of each kind
    assert sum(seen) >= X.MOST_EPOCHS // X.REFRESH * fit * (300 - X.WINDOW + 1)


def test_best_window_of_each_document(words):
    rng = np.random.default_rng(6)
    docs = [words[:100], [], words[100:110], words[110:400]]
    net, _ = X.start(docs, np.array([1, 0, 1, 0]), rng)
    used, own = np.unique(np.concatenate([np.array([words.index(w) for w in d], int) for d in docs]), return_inverse=True)
    pre = np.concatenate([net.inputs([words[k] for k in used])[0] @ net.p["wx"] + net.p["bx"], net.pad_row()[None]]).astype(np.float32)
    at = X.best_windows(net, pre, own, [len(d) for d in docs])
    assert [int((a < len(pre) - 1).sum()) for a in at] == [X.WINDOW, 0, 10, X.WINDOW]
    assert np.allclose(net.forward(pre, at), net.logits([" ".join(d) for d in docs]), atol=1e-4)


def test_context_between_windows_is_seen(words):
    """The highest logit is that of the best run of WINDOW words, wherever it begins."""
    net, _ = X.start([words[:80], words[80:160]], np.array([1, 0]), np.random.default_rng(2))
    text = words[:70]
    alone = [net.logits([" ".join(text[k : k + X.WINDOW])])[0] for k in range(70 - X.WINDOW + 1)]
    assert abs(net.logits([" ".join(text)])[0] - max(alone)) < 1e-4


def long_texts(words, n):
    """Texts of many chunks of windows, with documents that are empty, shorter than a window and longer; words that the training hasn't met."""
    rng = np.random.default_rng(9)
    pool = words + [f"{a}{b}" for a, b in zip(words, words[1:])]
    return [" ".join(pool[k] for k in rng.integers(0, len(pool), size)) for size in [n, 0, 1, X.WINDOW - 1, X.WINDOW, X.WINDOW + 1, n // 2]] + [None]


def test_all_chunks_equal_the_plain_passes(words):
    net, _ = X.start([words[:80], words[80:160]], np.array([1, 0]), np.random.default_rng(2))
    texts = long_texts(words, 2 * X.CHUNK)
    for text, got in zip(texts, net.logits(texts)):
        ws = X.words_of(text)
        pre = np.concatenate([net.inputs(ws)[0] @ net.p["wx"] + net.p["bx"] if ws else np.empty((0, 6 * X.HIDDEN)), net.pad_row()[None]]).astype(np.float32)
        at = np.array([[min(i + k, len(ws)) for k in range(X.WINDOW)] for i in range(max(1, len(ws) - X.WINDOW + 1))])
        assert abs(net.forward(pre, at).max() - got) < 1e-4


def test_scoring_works_in_the_cache(words):
    """What one chunk takes: states that are kept for every place, and one table of pre-activations more per slice, made scoring slow and workers large."""
    import tracemalloc

    net, _ = X.start([words[:80], words[80:160]], np.array([1, 0]), np.random.default_rng(2))
    net.logits(long_texts(words, 100))
    rows = net.rows_of(long_texts(words, 20 * X.CHUNK))[0]
    tracemalloc.start()
    net.slide(net.rows, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    floats_a_window = peak / 4 / X.CHUNK
    assert floats_a_window < 2 * X.HIDDEN * X.WINDOW  # so many the states of all places take
    assert net.rows.nbytes <= 2 * 4 * (len(net.memo) + 1) * (2 * X.DIM + 2)


def test_worker_of_long_texts_stays_small(words):
    """The pipeline's first stage has to leave room for the executor's JVM: what scoring takes depends neither on the batch nor on the length of its texts."""
    import tracemalloc

    import pyarrow as pa

    net, _ = X.start([words[:80], words[80:160]], np.array([1, 0]), np.random.default_rng(2))
    rng = np.random.default_rng(7)
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 4000)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    packed = X._packed(net)
    X._memo(packed)
    tracemalloc.start()
    got = [n for b in X._reject([batch], 0, packed, 2.0) for n in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == texts
    assert peak - sum(map(len, texts)) < 12 << 20


def test_shingles_of_one_document_take_no_room():
    """The driver keeps only what documents can meet by."""
    import tracemalloc

    docs = [[f"w{i}x{k}" for k in range(1000)] for i in range(100)]
    docs += [docs[0], [*docs[1][:500], "changed", *docs[1][501:]]]
    tracemalloc.start()
    got, _ = X.distinct(docs, [0] * len(docs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == docs[:100]
    assert peak < 7 << 20  # 102,000 shingles of 8 bytes, few times over
