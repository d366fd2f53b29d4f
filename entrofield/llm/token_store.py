"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

Shard file: 16-byte header (magic, item size), then the ids of its documents in ascending key order as raw little-endian
integers (16 bits if the vocabulary allows, else 32), then a footer (documents, tokens, magic).

Index: the keys are dealt by hash into buckets of bounded size; each bucket is one file with a minimal perfect hash function
(a cascade of bit arrays: at each level the keys that are alone at their place stay, the others go on; a key's slot is the rank
of its bit) and, per slot, a 32-bit fingerprint and the place of the document's ids: shard, first token, number of tokens.
A lookup hashes the key, reads a bounded expected number of bits and one slot; keys are not stored, the fingerprint rejects foreign
keys except one in 2**32.

Null keys have no index entry; their documents stand first in the files and are found through the locations table. Rows that share a key stand side by side in the order of the
table, in several shards if they are many; the key's slot then points to one run of rows per shard, and the locations table tells the rows of a run apart. So one hot key
makes neither a large shard nor a large bucket. Null texts are empty: they hold only the end id. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, key_hash, shared_dir, slices, stored

MAGIC = b"EFTOKID1"
IDX_MAGIC = b"EFMPHIX1"
HEAD, HEAD_BYTES = "<8sII", 16
FOOT = "<QQ8s"
PLACE = [("shard", "<i4"), ("first", "<i8"), ("n", "<i8"), ("docs", "<i8")]
LOCATION = "doc_id long, shard int, first long, n_tokens long"
#: Entries of each of the two generations of a worker's table of encoded words, about 90 MB.
CACHE = 400_000
#: Shards summed up together; bytes read at once, and between two locations that are still read together.
BLOCK, READ, GAP = 4096, 4 << 20, 64 << 10
#: Between an ASCII letter and one of these marks every pre-tokenizer of the supported files cuts.
JOINT = re.compile(rb"([a-z])([.,;:!?|$%&*#])")


# ---------------------------------------------------------------- encoding


#: Fixed value: the pre-tokenizer's pattern of the files that are encoded word by word.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def word_wise(config: dict) -> bool:
    """Whether a text's ids are those of its lower-cased words in turn: the normalizer joins blanks and lower-cases, the pre-tokenizer keeps what WORD_PATTERN finds and cuts no further."""
    normal = config.get("normalizer") or {}
    kinds = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        kinds == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": WORD_PATTERN}
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and not config.get("truncation")
        and not config.get("padding")
    )


class WordEncoder:
    """Whole texts to ids with the tokenizers library, remembering the ids of words where a tokenizer is word_wise().

    Blanks never survive such a pre-tokenizer and it lower-cases first, so a text's ids are those of its lower-cased words in turn. Texts with
    special-token syntax, where raw text matters, go to the library whole, and so do all texts under any other tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = word_wise(json.load(f))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, words: Iterable[bytes]) -> None:
        """Encodes unknown words. Words of letters alone are one pre-token each and go to the library joined by blanks, 1000 at a time."""
        if len(self.known) > CACHE:  # two generations: frequent words come back from the older one
            self.known, self.older = {}, self.known
        plain, others = [], []
        for w in dict.fromkeys(words):
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    (plain if (t := w.decode("utf-8", "surrogatepass")).isalpha() else others).append((w, t))
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            e = self.tok.encode(" ".join(t for _, t in part), add_special_tokens=False)
            ends = (np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)).cumsum() * self.dtype.itemsize).tolist()
            if len(ends) != len(part):
                others += part
                continue
            data, at = np.array(e.ids, self.dtype).tobytes(), 0
            for (w, _), end in zip(part, ends):
                self.known[w], at = data[at:end], end
        for (w, _), e in zip(others, self.tok.encode_batch([t for _, t in others], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or "<|" in text:
            return self.whole(text)
        words = JOINT.sub(rb"\1 \2", text.encode("utf-8", "surrogatepass").lower()).split()
        ids = list(map(self.known.get, words))
        if None in ids:
            self.learn(w for w, x in zip(words, ids) if x is None)
            ids = [self.known[w] if x is None else x for w, x in zip(words, ids)]
        return b"".join(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------- minimal perfect hash


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A keyed 64-bit finaliser over unsigned keys."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0x5EED) >> np.uint64(32)).astype("<u4")


class MinimalPerfectHash:
    """Cascade of bit arrays over distinct unsigned 64-bit keys; gamma is the array size per key at each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of 0/1 bytes
        self.rank, base = [], 0
        for bits in levels:
            self.rank.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
            if len(levels) > 64:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where no level holds it (then it is foreign)."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for depth, (bits, rank) in enumerate(zip(self.levels, self.rank)):
            at = (_mix(keys[left], depth) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def index_bytes(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray, docs: np.ndarray | None = None) -> bytes:
    """One bucket's file: per run of rows of a key in a shard its first token, number of tokens and of documents (1 by default). A key's runs are kept side by side; its slot points to the
    first and knows how many follow.
    """
    order = np.lexsort((first, shard, keys))
    docs = np.ones(len(keys), np.int64) if docs is None else docs
    keys, shard, first, count, docs = keys[order], shard[order], first[order], count[order], docs[order]
    unique, start, rows = np.unique(keys, return_index=True, return_counts=True)
    mph = MinimalPerfectHash.build(unique.view(np.uint64) if unique.dtype == np.int64 else unique)
    slot = mph.slots(unique.astype(np.int64).view(np.uint64))
    entry = np.zeros(len(unique), dtype=[("print", "<u4"), ("row", "<u4"), ("rows", "<u4")])
    entry["print"][slot], entry["row"][slot], entry["rows"][slot] = _fingerprint(unique.astype(np.int64).view(np.uint64)), start, rows
    place = np.zeros(len(keys), dtype=PLACE)
    place["shard"], place["first"], place["n"], place["docs"] = shard, first, count, docs
    out = [IDX_MAGIC, struct.pack("<III", len(mph.levels), len(unique), len(keys))]
    for bits in mph.levels:
        packed = np.packbits(bits)
        out += [struct.pack("<I", len(bits)), packed.tobytes()]
    return b"".join([*out, entry.tobytes(), place.tobytes()])


class IndexBucket:
    """A bucket's file in memory."""

    def __init__(self, data: bytes):
        if data[:8] != IDX_MAGIC:
            raise ValueError("not an index file")
        n_levels, n_keys, n_rows = struct.unpack_from("<III", data, 8)
        at, levels = 20, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<I", data, at)
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at + 4), count=size))
            at += 4 + n
        self.mph = MinimalPerfectHash(levels)
        self.entry = np.frombuffer(data, [("print", "<u4"), ("row", "<u4"), ("rows", "<u4")], n_keys, at)
        self.place = np.frombuffer(data, PLACE, n_rows, at + self.entry.nbytes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in keys, row of place) of every match; foreign keys give none."""
        u = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slot = self.mph.slots(u)
        ok = slot >= 0
        ok[ok] = self.entry["print"][slot[ok]] == _fingerprint(u[ok])
        pos, e = np.flatnonzero(ok), self.entry[slot[ok]]
        n = e["rows"].astype(np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pos, n), np.repeat(e["row"].astype(np.int64), n) + within


# ---------------------------------------------------------------- writing


def _write_shard(batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One task, one shard: streams ids to a private name and renames it at the end, so that a repeated task replaces its file whole."""
    enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
    end = np.array([end_id], enc.dtype).tobytes()
    fs, path = filesystem(root)
    own, rows, tokens, out = f"{path}/.shard-{shard:06d}-{uuid.uuid4().hex}", 0, 0, None
    for b in slices(batches):
        if out is None:
            fs.create_dir(path, recursive=True)
            out = fs.open_output_stream(own)
            out.write(struct.pack(HEAD, MAGIC, enc.dtype.itemsize, end_id))
        texts = b.column(1).to_pylist()
        enc_ids = [enc.encode(t or "") + end for t in texts]
        out.write(b"".join(enc_ids))
        n = np.array([len(x) // enc.dtype.itemsize for x in enc_ids], np.int64)
        first = tokens + np.cumsum(n) - n
        rows, tokens = rows + len(n), tokens + int(n.sum())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(first), pa.array(n)], names=["doc_id", "shard", "first", "n_tokens"])
    if out is not None:
        out.write(struct.pack(FOOT, rows, tokens, MAGIC))
        out.close()
        fs.move(own, f"{path}/shard-{shard:06d}.bin")


def _write_index(key: tuple, rows: pd.DataFrame, root: str) -> pd.DataFrame:
    fs, path = filesystem(root)
    data = index_bytes(rows["doc_id"].to_numpy(np.int64), rows["shard"].to_numpy(np.int32), rows["first"].to_numpy(np.int64), rows["n_tokens"].to_numpy(np.int64), rows["rows"].to_numpy(np.int64))
    fs.create_dir(path, recursive=True)
    own = f"{path}/.index-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/index-{key[0]:06d}.mph")
    return pd.DataFrame({"bucket": [key[0]], "n_rows": [len(rows)], "n_docs": [int(rows["rows"].sum())], "n_bytes": [len(data)]})


class TokenStore:
    """A written store: root folder, number of index buckets, locations table."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int, locations: DataFrame, repeated: bool):
        self.spark, self.root, self.n_buckets, self.locations, self.repeated = spark, root, n_buckets, locations, repeated

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end_id: int = 2, root: str | None = None, docs_per_shard: int = 8192, keys_per_bucket: int = 250_000) -> TokenStore:
        """Encodes `text` of docs by `doc_id` and writes shards and index.

        The text is dealt by key range before it is encoded, so that it is encoded once and a shard is a sorted run. Shards hold about docs_per_shard
        documents and buckets keys_per_bucket keys at any size of the input.
        """
        spark = docs.sparkSession
        bounded_batches(spark)
        root = root or shared_dir(spark, "tokens")
        n = docs.count()
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        keys = [F.col("doc_id"), F.col("row")]  # the row splits a key with many rows
        runs = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // docs_per_shard)), *keys).sortWithinPartitions(*keys).drop("row")
        payload = f"{root}/payload"
        locations = stored(runs.mapInArrow(lambda it: _write_shard(it, payload, tokenizer, end_id), LOCATION), f"{root}/locations")
        n_buckets = max(1, -(-n // keys_per_bucket))
        keyed = locations.where("doc_id is not null").groupBy("doc_id", "shard").agg(F.min("first").alias("first"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")).withColumn("bucket", bucket_of(n_buckets))
        index = f"{root}/index"
        buckets = stored(keyed.groupBy("bucket").applyInPandas(lambda k, rows: _write_index(k, rows, index), "bucket int, n_rows long, n_docs long, n_bytes long"), f"{root}/buckets")
        return cls(spark, root, n_buckets, locations, bool(buckets.where("n_docs > n_rows").limit(1).count()))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Locations of the given doc_id values through the index; a repeated key gives each of its rows once, a foreign key none."""
        root, keys = f"{self.root}/index", keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()

        def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            fs, path = filesystem(root)
            with fs.open_input_stream(f"{path}/index-{key[0]:06d}.mph") as f:
                bucket = IndexBucket(f.read())
            ids = rows["doc_id"].to_numpy(np.int64)
            pos, row = bucket.find(ids)
            place = bucket.place[row]
            return pd.DataFrame({"doc_id": ids[pos], "shard": place["shard"], "first": place["first"], "n_tokens": place["n"], "docs": place["docs"]})

        runs = keys.withColumn("bucket", bucket_of(self.n_buckets)).groupBy("bucket").applyInPandas(find, f"{LOCATION}, docs long")
        if not self.repeated:
            return runs.drop("docs")
        several = runs.where("docs > 1").select("doc_id", "shard")
        return runs.where("docs = 1").drop("docs").unionByName(self.locations.join(several, ["doc_id", "shard"], "left_semi"))

    def bases(self) -> DataFrame:
        """Tokens before each shard; one row per shard. Summed up within blocks of shards and over the blocks, so that one task sees a row per BLOCK shards."""
        n = self.locations.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr(f"shard div {BLOCK}"))
        blocks = n.groupBy("block").agg(F.sum("n").alias("all"))
        blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))
        within = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
        return n.withColumn("within", within).join(blocks, "block").select("shard", (F.col("before") + F.col("within")).alias("base"))

    def read(self, places: DataFrame, digest: bool = False) -> DataFrame:
        """The ids of the given locations, shard by shard: `ids` as an array, or with digest only their unsigned crc32 over 32-bit little-endian ids.

        Locations that follow one another closely in a shard are read together, READ bytes at most unless one is longer.
        """
        root, kind = f"{self.root}/payload", "ids_crc32 long" if digest else "ids array<int>"

        def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, path = filesystem(root)
            opened, file, width = None, None, 0
            for pdf in batches:
                out: list = []
                shard, first = pdf["shard"].to_numpy(), pdf["first"].to_numpy()
                end = first + pdf["n_tokens"].to_numpy()
                i = 0
                while i < len(pdf):
                    if shard[i] != opened:
                        if file:
                            file.close()
                        file, opened = fs.open_input_file(f"{path}/shard-{shard[i]:06d}.bin"), shard[i]
                        magic, width, _ = struct.unpack(HEAD, file.read_at(HEAD_BYTES, 0))
                        if magic != MAGIC:
                            raise ValueError(f"shard {opened} is not a token file")
                    k = i + 1
                    while k < len(pdf) and shard[k] == opened and (first[k] - end[k - 1]) * width < GAP and (end[k] - first[i]) * width <= READ:
                        k += 1
                    ids = np.frombuffer(file.read_at(int(end[k - 1] - first[i]) * width, HEAD_BYTES + int(first[i]) * width), f"<u{width}").astype("<u4")
                    parts = [ids[a:b] for a, b in zip((first[i:k] - first[i]).tolist(), (end[i:k] - first[i]).tolist())]
                    out += [zlib.crc32(x.tobytes()) if digest else x.astype(np.int32) for x in parts]
                    i = k
                yield pdf[["doc_id", "shard", "first", "n_tokens"]].assign(**{kind.split()[0]: out})

        return places.repartition(F.col("shard")).sortWithinPartitions("shard", "first").mapInPandas(load, f"{LOCATION}, {kind}")


def bucket_of(n: int):
    return F.pmod(key_hash("doc_id", seed=29), F.lit(n)).cast("int")


def read_back(docs: DataFrame, store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, located through the index and read from the shards; rows without a key come from the locations table."""
    places = store.lookup(docs).unionByName(store.locations.where("doc_id is null"))
    got = store.read(places, digest=True).join(store.bases(), "shard")
    return got.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
