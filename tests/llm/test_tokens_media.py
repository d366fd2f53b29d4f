import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from entrofield.llm import media_png as M
from entrofield.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's a<|endoftext|>Test", "<|ENDOFTEXT|> x", "naïve café.—…. a.́b 12ab3 İstanbul ΣΑΣ", "", "a\x1cb c\x85d", "don't!!can't", "Åﬁ ½ ²x", "日本語 テキスト.", "é.é,x", "́.a"]


def test_encoder_equals_library(texts):
    tok, enc = Tokenizer.from_file(PATH), T.WordEncoder(PATH)
    for t in [*texts[:60], *ODD]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_get_whole_texts(texts):
    """Byte-level files keep case and blanks; they are known by their configuration."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), T.WordEncoder(path)
    assert not enc.by_word and T.WordEncoder(PATH).by_word
    for t in [*texts[:20], *ODD, "Hello big World, again. "]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_one_key_with_many_rows(spark):
    """Rows of one id, or of none, are spread over shards; each is found through the index and read."""
    rows = [(7, f"word{i % 50} two") for i in range(900)] + [(None, "no id")] * 600 + [(i, "x") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    store = T.TokenStore.write(df, PATH, docs_per_shard=100, keys_per_bucket=20)
    per = {r.shard: r["count"] for r in store.locations.groupBy("shard").count().collect()}
    assert max(per.values()) < 400 and store.repeated
    got = T.read_back(df, store).toPandas()
    tok = Tokenizer.from_file(PATH)
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.ids_crc32) for r in got.itertuples()) == sorted((-1 if i is None else i, crc(t)) for i, t in rows)
    order = got.sort_values("start")
    assert (order.start.to_numpy() == np.concatenate([[0], order.n_tokens.cumsum()[:-1]])).all() and (np.diff(order.doc_id.dropna().to_numpy()) >= 0).all()


def test_bases_over_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 2)
    monkeypatch.setattr(T, "READ", 200)
    store = T.TokenStore.write(docs, PATH, docs_per_shard=8)
    n = {r.shard: r.n for r in store.locations.groupBy("shard").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert {r.shard: r.base for r in store.bases().collect()} == {k: sum(v for j, v in n.items() if j < k) for k in n}
    assert T.read_back(docs, store).count() == docs.count()


@pytest.mark.parametrize("n", [1, 2, 17, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    h = T.MinimalPerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))


def test_index_finds_keys_and_rejects_strangers():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.choice(1 << 40, 3000, replace=False) - (1 << 39), [7, 7, 7]])
    data = T.index_bytes(keys, np.arange(len(keys)) % 5, np.arange(len(keys)) * 10, np.arange(len(keys)))
    b = T.IndexBucket(data)
    pos, row = b.find(keys[:3000])
    assert (pos == np.arange(3000)).all() and (b.place["first"][row] == np.arange(3000) * 10).all()
    pos, row = b.find(np.array([7]))
    assert len(pos) == 3 and sorted(b.place["n"][row].tolist()) == [3000, 3001, 3002]
    assert len(b.find(rng.integers(1 << 41, 1 << 42, 5000))[0]) <= 1


def test_store_round_trip(spark, docs, empty):
    store = T.TokenStore.write(docs, PATH, docs_per_shard=30, keys_per_bucket=40)
    got = T.read_back(docs, store).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    assert len(got) == len(rows)
    tok = Tokenizer.from_file(PATH)
    want = [(None if r.doc_id != r.doc_id else int(r.doc_id), [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in rows.itertuples()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    have = sorted((-1e9 if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples())
    assert have == sorted((-1e9 if i is None else i, len(x), crc(x)) for i, x in want)
    keyed = sorted(got.start.tolist())
    order = got.sort_values("start")
    assert keyed[0] == 0 and (order.start.to_numpy()[1:] == order.start.to_numpy()[:-1] + order.n_tokens.to_numpy()[:-1]).all()
    ids = order.doc_id.dropna().to_numpy()
    assert (np.diff(ids) >= 0).all()
    missing = spark.createDataFrame([(123456789,)], "doc_id long")
    assert store.lookup(missing).count() == 0
    whole = store.read(store.lookup(docs.where("doc_id = -40"))).first()
    assert whole.ids == next(x for i, x in want if i == -40)
    assert T.read_back(empty, T.TokenStore.write(empty, PATH)).count() == 0


# ---------------------------------------------------------------- media


def test_png_round_trip(texts):
    for t in ["", "a", "x" * 64, texts[0], texts[-1], "é" * 100]:
        for adaptive in (False, True):
            data = t.encode()
            samples, n = M.decode_png(M.encode_png(data, adaptive))
            assert n == len(data) and samples.tobytes() == M.pad(data) and len(M.pad(data)) % 64 == 0 and M.pad(data)


@pytest.mark.parametrize("kind", range(5))
def test_unfilter_every_kind(kind):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (9, 64)).astype(np.uint8)
    raw = np.zeros((9, 65), np.uint8)
    kinds = np.full(9, kind)
    kinds[4] = (kind + 1) % 5
    for r in range(9):
        for x in range(64):
            a, b = int(rows[r, x - 1]) if x else 0, int(rows[r - 1, x]) if r else 0
            c = int(rows[r - 1, x - 1]) if x and r else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw[r, x + 1] = (int(rows[r, x]) - (0, a, b, (a + b) // 2, paeth)[kinds[r]]) % 256
    raw[:, 0] = kinds
    assert (M.unfilter(raw) == rows).all()


def test_png_damage_is_found():
    data = bytearray(M.encode_png(b"hello world" * 20))
    data[60] ^= 1
    with pytest.raises(ValueError):
        M.decode_png(bytes(data))


def test_media_features(docs, empty):
    got = M.media_features(M.store_media(docs)).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    want = sorted((len((t or "").encode()), hashlib.sha256(M.pad((t or "").encode())).hexdigest()) for t in rows.text)
    assert sorted(zip(got.n_bytes, got.payload_sha256)) == want
    assert got.groupby("payload_sha256").agg({"phash": lambda s: len(set(map(bytes, s))), "media_sha256": "nunique"}).max().max() == 1
    assert M.media_features(M.store_media(empty)).count() == 0


def test_cosine_hash_brute_force():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    small = a.reshape(32, 2, 32, 2).mean((1, 3))
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (y + 0.5) * u / 32) * np.cos(np.pi * (x + 0.5) * v / 32) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    mine = np.unpackbits(np.frombuffer(M.cosine_hash(a), np.uint8)).astype(bool)
    assert (bits == mine).mean() > 0.98
    noisy = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    assert (np.unpackbits(np.frombuffer(M.cosine_hash(noisy), np.uint8)) == mine).mean() > 0.9
