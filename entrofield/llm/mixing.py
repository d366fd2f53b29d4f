"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by a keyed hash into at most BLOCKS blocks. A source whose target is f times its size is drawn
floor(f) times whole; of the rest, blocks are drawn in a keyed permuted order as they fit, and one more block in part, by sub-blocks, so that
the words taken come within half a sub-block of the target. All drawn blocks of a source form its quota. The tree halves the range of output
shards again and again and draws how many blocks of each source the left half gets from the multivariate hypergeometric law; at a leaf, a shard
takes its numbers of blocks from each source's permuted sequence, so that draws are disjoint. Within a shard, rows are shuffled by a keyed
hash.

The tree has two storeys. The driver splits whole blocks among at most STEMS stems. Where more shards are wanted, each stem's blocks are cut into UNITS units and a task per stem
goes on with the same tree over units and the stem's shards (UNITS at most; beyond STEMS * UNITS shards, shards grow). Only block tables reach the driver: BLOCKS rows per source, fewer
where there are so many sources that these would be more than MOST_ROWS, but 16 at least. So memory on the driver grows with the number of sources alone.

Null texts have size 0. A null source is a source of its own, after all others. Sources without words have target 0 and are not
drawn. Repeated rows fall in the same block and are drawn together. An empty table gives an empty mix. Other columns are carried along
whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_hash, shared_dir, stored, word_count

BLOCKS, STEMS, UNITS = 1024, 512, 1024
MOST = 3.0
#: Tasks that write a mix, at least.
TASKS = 32
#: Rows of a block table on the driver; and of a table of draws that is sent to all tasks, larger ones are joined by a shuffle.
MOST_ROWS, BROADCAST_ROWS = 1 << 20, 200_000


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = 1.0, most: float = MOST) -> list[float]:
    """Words of each source: share of all words by weight; none over most times its size, the excess reshared by weight until none is above."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in set(free))
        w = sum(weights[i] for i in free)
        want = {i: left * weights[i] / w for i in free}
        over = [i for i in free if want[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = want[i]
            break
        for i in over:
            out[i] = most * float(sizes[i])
        free = [i for i in free if i not in set(over)]
    return out


def split_tree(quotas: Sequence[int], n_shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source for each shard. Every node draws its left child's share from what it holds; the right child gets the rest."""
    leaves: list[list[int]] = [[] for _ in range(n_shards)]
    todo = [(0, n_shards, np.array(quotas, np.int64))]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            leaves[lo] = held.tolist()
            continue
        mid = (lo + hi) // 2
        n_left = int(round(held.sum() * (mid - lo) / (hi - lo)))
        left = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(held, n_left) if len(held) else held
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return leaves


def take(order: Sequence[tuple[int, int]], room: float) -> tuple[list[int], float]:
    """Items (id, words) that fit in turn, and the room left."""
    got = []
    for k, words in order:
        if words <= room:
            got.append(k)
            room -= words
    return got, room


class Mix:
    """A mix drawn over a table; see plan()."""

    def __init__(self, docs: DataFrame, sized: DataFrame, draws: DataFrame, sources: DataFrame, n_shards: int, blocks: int, seed: int):
        self.docs, self.sized, self.draws, self.sources, self.n_shards, self.blocks, self.seed = docs, sized, draws, sources, n_shards, blocks, seed

    def per_document(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, shards: what the mix takes of each row of the table."""
        rows = self.sized.join(self.draws, ["skey", "block"], "left").join(self.sources, "skey", "left")
        copies = F.coalesce(drawn_shards(), F.array().cast("array<int>"))
        return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(copies)).cast("long").alias("taken"), copies.alias("shards"))

    def mixed(self) -> DataFrame:
        """The mixed rows, a document as often as it is drawn, dealt to shards and shuffled within; columns as in docs."""
        names = self.docs.columns
        rows = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *block_columns(F.col("doc_id"), F.col("text"), F.col("source"), self.blocks, self.seed))
        rows = rows.join(self.draws, ["skey", "block"]).select("row", "hash", F.posexplode(drawn_shards()).alias("copy", "shard"))
        pieces = max(1, TASKS // self.n_shards)  # few shards are dealt over several tasks each
        rows = rows.withColumn("order", key_hash("hash", "copy", seed=self.seed + 7)).withColumn("piece", F.pmod(F.shiftright("order", 20), F.lit(pieces)))
        return rows.repartition(self.n_shards * pieces, "shard", "piece").sortWithinPartitions("shard", "piece", "order").select("row.*")


def drawn_shards() -> Column:
    """Shards of a row: those of its block's draws, of a partial draw only if its sub-block is in it."""
    mine = F.filter("draws", lambda d: d["subs"].isNull() | F.array_contains(d["subs"], F.col("sub")))
    return F.transform(mine, lambda d: F.coalesce(F.get(d["shards"], F.col("unit")), d["stem"]))


def block_columns(doc_id: Column, text: Column, source: Column, blocks: int, seed: int) -> list[Column]:
    h = key_hash(doc_id, text, seed=seed)
    part = lambda shift, n, name: F.pmod(F.shiftright(h, shift), F.lit(n)).cast("int").alias(name)
    return [F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~")).alias("skey"), h.alias("hash"), part(0, blocks, "block"), part(24, blocks, "sub"), part(40, UNITS, "unit")]


def sized_table(spark: SparkSession, df: DataFrame, n: int) -> DataFrame:
    """df, to be sent to all tasks if its n rows are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def grow(key: tuple, rows: pd.DataFrame, per_stem: int, seed: int) -> pd.DataFrame:
    """The upper storey of one stem: which of its per_stem shards each unit of each of its draws goes to."""
    rows = rows.sort_values(["skey", "block", "copy"], na_position="last").reset_index(drop=True)
    keys = sorted(set(rows["skey"]))
    at = {k: np.flatnonzero((rows["skey"] == k).to_numpy()) for k in keys}
    tree = np.array(split_tree([len(at[k]) * UNITS for k in keys], per_stem, seed + 1 + int(key[0])))
    out = np.empty((len(rows), UNITS), np.int32)
    for i, k in enumerate(keys):
        rng = np.random.Generator(np.random.PCG64([seed, int(key[0]), i]))
        flat = np.empty(len(at[k]) * UNITS, np.int32)
        flat[rng.permutation(len(flat))] = np.repeat(np.arange(per_stem), tree[:, i])
        out[at[k]] = flat.reshape(-1, UNITS)
    return rows.assign(shards=list(out + int(key[0]) * per_stem))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, shard_words: int = 2_000_000, stems: int = STEMS, seed: int = 17) -> Mix:
    """Draws the mix, in shards of about shard_words. weights repeat over the sources in code-point order, null last."""
    spark = docs.sparkSession
    root = shared_dir(spark, "mix")
    n_sources = docs.select("source").distinct().count()
    n_blocks = max(16, min(BLOCKS, MOST_ROWS // max(1, n_sources)))
    sized = stored(docs.select("doc_id", word_count(F.col("text")).alias("size"), *block_columns(F.col("doc_id"), F.col("text"), F.col("source"), n_blocks, seed)), f"{root}/sized")
    blocks: dict[str, list[tuple[int, int]]] = {}
    all_keys: set[str] = set()
    for r in sized.groupBy("skey", "block").agg(F.sum("size").alias("w")).collect():  # at most n_blocks rows a source
        all_keys.add(r["skey"])
        if r["w"]:
            blocks.setdefault(r["skey"], []).append((r["block"], r["w"]))
    all_keys = sorted(all_keys, key=lambda k: (k == "~", k))
    sources = [k for k in all_keys if k in blocks]
    sizes = [sum(w for _, w in blocks.get(k, [])) for k in all_keys]
    weight = [weights[i % len(weights)] for i in range(len(all_keys))]
    target = dict(zip(all_keys, targets(sizes, weight, share)))
    size = dict(zip(all_keys, sizes))

    whole: dict[str, int] = {}
    parts: dict[str, list[int]] = {}
    order: dict[str, list[tuple[int, int]]] = {}
    border: dict[str, tuple[int, float]] = {}
    for k in sources:
        order[k] = sorted(blocks[k])
        random.Random(f"{seed}|{k}").shuffle(order[k])
        whole[k] = min(int(MOST), int(target[k] / size[k] + 1e-12))
        parts[k], room = take(order[k], target[k] - whole[k] * size[k])
        rest = [(w, b) for b, w in order[k] if b not in set(parts[k])]
        if rest and room > 0.5 and whole[k] < MOST:
            border[k] = (min(rest)[1], room)
    subs = draw_border(spark, sized, border, seed)

    quotas = [whole[k] * len(order[k]) + len(parts[k]) + (k in subs) for k in sources]
    wanted = max(1, -(-int(sum(target.values())) // shard_words))
    n_stems = min(stems, wanted)
    per_stem = min(UNITS, -(-wanted // n_stems))
    tree = split_tree(quotas, n_stems, seed)
    rows = []
    for i, k in enumerate(sources):
        ids = [b for b, _ in order[k]]
        sequence = ids * whole[k] + parts[k] + ([-1] if k in subs else [])
        random.Random(f"{seed}|{k}|sequence").shuffle(sequence)
        ends = list(accumulate(leaf[i] for leaf in tree))
        stem_of = np.repeat(np.arange(n_stems), np.diff([0, *ends])).tolist()
        copies: dict[int, int] = {}
        for b, stem in zip(sequence, stem_of):
            copies[b] = copies.get(b, -1) + 1
            rows.append((k, border[k][0] if b < 0 else b, stem, None if b < 0 else copies[b], subs[k] if b < 0 else None))
    schema = "skey string, block int, stem int, copy int, subs array<int>"
    draws = spark.createDataFrame(rows, schema)
    if per_stem > 1:
        draws = stored(draws.groupBy("stem").applyInPandas(lambda key, part: grow(key, part, per_stem, seed), f"{schema}, shards array<int>"), f"{root}/draws")
    else:
        draws = draws.withColumn("shards", F.lit(None).cast("array<int>"))
    draws = draws.groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "stem", "subs", "shards"))).alias("draws"))  # at most MOST + 1 of a block
    table = spark.createDataFrame([(k, int(size[k]), float(target[k])) for k in all_keys], "skey string, source_size long, target double")
    return Mix(docs, sized, sized_table(spark, draws, len(rows) * (UNITS if per_stem > 1 else 1)), sized_table(spark, table, len(all_keys)), n_stems * per_stem, n_blocks, seed)


def draw_border(spark: SparkSession, sized: DataFrame, border: dict[str, tuple[int, float]], seed: int) -> dict[str, list[int]]:
    """Sub-blocks taken of the one block of each source that is drawn in part; one more than fits if that comes nearer the target."""
    at = spark.createDataFrame([(k, b) for k, (b, _) in border.items()], "skey string, block int")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in sized.join(sized_table(spark, at, len(border)), ["skey", "block"]).groupBy("skey", "sub").agg(F.sum("size").alias("w")).where("w > 0").collect():  # at most as many rows a source as it has blocks
        found.setdefault(r["skey"], []).append((r["sub"], r["w"]))
    out = {}
    for k, items in found.items():
        items.sort()
        random.Random(f"{seed}|{k}|subs").shuffle(items)
        got, room = take(items, border[k][1])
        rest = [(w, s) for s, w in items if s not in set(got)]
        if rest and min(rest)[0] - room < room:
            got.append(min(rest)[1])
        if got:
            out[k] = sorted(got)
    return out
