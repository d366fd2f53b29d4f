import numpy as np
import pytest

from entrofield.llm import mixing, packing


def naive(lengths, sizes, quad):
    """Best fit by looking at every open bin (among equal rooms the one that got an item last); a new bin by trying every length on the pieces still to come."""
    bins, where, stamp = [], [], 0
    cost = lambda n: packing.bin_cost(min(s for s in sizes if s >= n), quad)
    for i, n in enumerate(lengths):
        stamp += 1
        fitting = [(room, -at, i) for i, (room, at, _) in enumerate(bins) if room >= n]
        if fitting:
            _, _, k = min(fitting)
        else:
            tried = []
            for size in sizes:
                if size >= n:
                    room = size - n
                    for later in lengths[i + 1 :]:
                        if later <= room:
                            room -= later
                    tried.append((cost(size - room) / (size - room), size))
            best = min(t for t, _ in tried)
            k = len(bins)
            bins.append([next(s for t, s in tried if t < best + 1e-12), 0, 0])
        bins[k] = [bins[k][0] - n, stamp, bins[k][2] + n]
        where.append(k)
    return where, [b[2] for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_fit_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array(sorted(rng.integers(1, 120, 400).tolist(), reverse=True))
    for quad in (50.0, 500.0, 32768.0):
        where, capacity, cost = packing.pack_shard(lengths, (32, 64, 128), quad)
        w, f = naive(lengths.tolist(), (32, 64, 128), quad)
        assert where.tolist() == w and capacity.tolist() == [min(s for s in (32, 64, 128) if s >= n) for n in f]
        assert cost == pytest.approx(sum(packing.bin_cost(c, quad) for c in capacity))


def cheapest(lengths, sizes, quad):
    """Least cost of all partitions into bins."""
    best = np.inf

    def go(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(packing.bin_cost(min(s for s in sizes if s >= b), quad) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= sizes[-1]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_cost_is_near_the_least():
    """Against every partition of small shards; never above the best of packing into one length alone."""
    rng = np.random.default_rng(5)
    ratio = []
    for _ in range(60):
        lengths = np.array(sorted(rng.integers(1, 17, rng.integers(1, 8)).tolist(), reverse=True))
        quad = float(rng.choice([8, 32, 1000]))
        ratio.append(packing.pack_shard(lengths, (4, 8, 16), quad)[2] / cheapest(lengths.tolist(), (4, 8, 16), quad))
    assert min(ratio) >= 1 - 1e-9 and np.mean(ratio) < 1.05 and max(ratio) < 1.4


def test_lengths_are_chosen_jointly():
    """Large and small bins in one shard, each where it is cheapest."""
    lengths = np.array([100, 60, 4, 4, 4, 4, 3, 1])
    where, capacity, _ = packing.pack_shard(lengths, (16, 64, 128), 100.0)
    assert sorted(capacity.tolist()) == [16, 64, 128] or len(set(capacity.tolist())) > 1


def test_one_key_with_many_rows(spark, monkeypatch):
    """Rows of one id and length beyond a shard are spread over the shards, and all are packed once."""
    df = spark.createDataFrame([(None, "")] * 3000 + [(7, "a b c")] * 500 + [(i, "x " * (i % 9)) for i in range(500)], "doc_id long, text string").repartition(4)
    for limit in (packing.BROADCAST_ROWS, 0):
        monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)
        rows = packing.best_fit_pack(df, (8, 16), docs_per_shard=200).toPandas()
        assert len(rows) == 4000 and rows.doc_id.isna().sum() == 3000 and rows.groupby("shard").size().max() < 500
        assert (rows.groupby(["shard", "bin"]).n_tokens.sum() <= rows.groupby(["shard", "bin"]).capacity.first()).all()


def test_pack_whole_documents(docs):
    rows = packing.best_fit_pack(docs, (64, 128, 512), docs_per_shard=50).toPandas()
    sizes = docs.select("doc_id", packing.word_count(docs["text"]).alias("n")).toPandas()
    assert rows["n_tokens"].sum() == (sizes["n"] + 1).sum()
    bins = rows.groupby(["shard", "bin"]).agg(n=("n_tokens", "sum"), c=("capacity", "first"), k=("capacity", "nunique"))
    assert (bins.n <= bins.c).all() and (bins.k == 1).all()
    assert all(c == min(s for s in (64, 128, 512) if s >= n) for n, c in zip(bins.n, bins.c))
    for _, b in rows.sort_values("bin_offset").groupby(["shard", "bin"]):
        assert (b.bin_offset.to_numpy() == np.concatenate([[0], b.n_tokens.cumsum()[:-1]])).all()
    long = rows[rows.piece > 0]
    assert len(long) and (long.start == long.piece * 512).all()


def test_pack_reruns_agree_and_empty(docs, empty):
    a, b = [packing.best_fit_pack(d, docs_per_shard=40).toPandas().sort_values(["shard", "bin", "bin_offset"]).reset_index(drop=True) for d in (docs, docs.repartition(3))]
    assert a.equals(b)
    assert packing.best_fit_pack(empty).count() == 0


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000], [5, 2]) == pytest.approx([30, 980])
    assert mixing.targets([0, 50], [5, 2]) == pytest.approx([0, 50])
    assert mixing.targets([], []) == []


def test_split_tree_keeps_quotas():
    quotas = [1000, 300, 7, 0]
    leaves = mixing.split_tree(quotas, 13, seed=3)
    assert np.sum(leaves, axis=0).tolist() == quotas
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 2
    assert leaves == mixing.split_tree(quotas, 13, seed=3)


def test_split_tree_is_hypergeometric():
    """The share of the first source in the first of two shards has the hypergeometric mean and variance."""
    got = np.array([mixing.split_tree([40, 60], 2, seed=s)[0][0] for s in range(2000)])
    assert got.mean() == pytest.approx(20, abs=0.3)
    assert got.var() == pytest.approx(50 * 0.4 * 0.6 * 50 / 99, rel=0.15)


def test_mix_meets_targets(docs):
    plan = mixing.plan(docs, shard_words=5000)
    rows = plan.per_document().toPandas()
    assert len(rows) == docs.count() and (rows.taken <= 3 * rows["size"]).all()
    total = rows["size"].sum()
    assert rows.drop_duplicates("target").target.sum() == pytest.approx(total, rel=1e-6)
    names = docs.select("doc_id", "text", "source").toPandas().fillna("~")
    mixed = plan.mixed()
    assert mixed.columns == docs.columns
    per = mixed.groupBy("source").count().toPandas().fillna("~").set_index("source")["count"]
    assert per.sum() == rows.shards.map(len).sum() and set(per.index) <= set(names.source)
    for t, g in rows.groupby("target"):
        assert g.taken.sum() == pytest.approx(t, abs=max(0.05 * t, 130)) or g["size"].max() > t


def test_mix_reruns_agree_and_empty(docs, empty):
    a, b = [mixing.plan(d).per_document().toPandas() for d in (docs, docs.repartition(2))]
    key = ["doc_id", "size", "taken"]
    assert a.sort_values(key).taken.tolist() == b.sort_values(key).taken.tolist()
    assert mixing.plan(empty).mixed().count() == 0 and mixing.plan(empty).per_document().count() == 0


def test_tree_reaches_every_shard(docs, monkeypatch):
    """Two storeys: each unit of each drawn block in one shard, shards of a stem as even as the tree makes them, draws joined by a shuffle; the same rows as with one storey."""
    one = mixing.plan(docs, shard_words=10**9)
    want = one.per_document().toPandas()
    for limit in (mixing.BROADCAST_ROWS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
        plan = mixing.plan(docs, shard_words=500, stems=4)
        assert plan.n_shards > 40
        rows = plan.per_document().toPandas()
        key = ["doc_id", "size", "taken"]
        assert rows[key].sort_values(key).astype(float).fillna(-1).values.tolist() == want[key].sort_values(key).astype(float).fillna(-1).values.tolist()
        used = [s for v in rows.shards for s in v]
        assert len(set(used)) > 30 and max(used) < plan.n_shards and plan.mixed().count() == len(used)


def test_upper_storey_keeps_quotas():
    import pandas as pd

    rows = pd.DataFrame({"skey": ["=a"] * 5 + ["~"] * 2, "block": [1, 1, 2, 3, 4, 1, 2], "stem": 3, "copy": [0, 1, 0, 0, None, 0, 0], "subs": None})
    got = mixing.grow((3,), rows, 6, seed=5)
    flat = np.stack(got.shards)
    assert flat.shape == (7, mixing.UNITS) and flat.min() == 18 and flat.max() == 23
    per = np.bincount(flat.ravel() - 18)
    assert per.max() - per.min() <= 4 and got.shards.map(list).tolist() == mixing.grow((3,), rows.sample(frac=1, random_state=1), 6, seed=5).shards.map(list).tolist()


def test_many_sources(spark):
    """Block tables shrink with the number of sources; targets are still met to a document."""
    rows = [(i, "w " * (1 + i % 7), f"host{i % 300}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old, mixing.MOST_ROWS = mixing.MOST_ROWS, 300 * 20
    try:
        plan = mixing.plan(df)
        assert plan.blocks == 20
        for t, g in plan.per_document().toPandas().groupby(["target", "source_size"]):
            n = g["size"].sum() / t[1]
            assert g.taken.sum() / n == pytest.approx(t[0], abs=8)
    finally:
        mixing.MOST_ROWS = old


def test_query_equals_brute_force(spark, sf):
    """What op10 takes, from the definition: sizes, sources and targets by a loop; the draws within their bounds."""
    import re

    from entrofield.llm.queries import op10_mixing

    docs = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    names = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    size = {s: sum(n for _, n, x in docs if x == s) for s in names}
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    got = op10_mixing(spark, sf).toPandas()
    assert sorted(zip(got.doc_id, got["size"], got.source_size, got.target.round(6))) == sorted((d, n, size[s], round(goal[s], 6)) for d, n, s in docs)
    taken = dict(zip(got.doc_id, got.taken))
    assert all(taken[d] in (0, n, 2 * n, 3 * n) for d, n, _ in docs)
    for s in names:
        assert sum(taken[d] for d, _, x in docs if x == s) == pytest.approx(goal[s], abs=max(n for _, n, x in docs if x == s))
    assert sum(size.values()) == pytest.approx(sum(goal.values()))
