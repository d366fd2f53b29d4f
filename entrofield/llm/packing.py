"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt by hash into shards of about `docs_per_shard`, independent of the size of the input; each shard is packed on its own:

1. A document longer than the largest permitted length is cut into pieces of that length and a rest.
2. Pieces in descending length go to the open bin that they fill best (least room left over).
3. If none has room, a bin is opened for the piece. Every permitted length that holds it is tried: the room left is filled with the pieces still to come, largest first, and the bin
   downsized to what it then holds. The length with the least cost per token is opened (ties: the smaller one). A bin of c tokens costs c + c*c/quad: linear layers and attention.
4. At the end each bin is downsized to the least permitted length that holds its contents.

Null and empty texts have only their end token and are packed like others. Repeated rows are packed as often as they occur. Rows with one id (or none) and one length that are more than a
shard are dealt over the shards by their place in the table. Equal lengths are taken by doc_id (nulls first), then piece, so that reruns agree. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_hash, shared_dir, stored, word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Keys of more than a shard that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SCHEMA = "doc_id long, piece int, start long, n_tokens int, shard long, bin int, capacity int, bin_offset int"


def bin_cost(capacity: int, quad: float) -> float:
    return capacity + capacity * capacity / quad


def fill(room: int, values: list[int], count: dict[int, int], less: int = 0) -> int:
    """Tokens put into room by taking available lengths, largest first; one piece of length `less` is not available. values: lengths with pieces left, ascending."""
    left, k = room, bisect_right(values, room)
    while k:
        v = values[k - 1]
        take = min(left // v, count[v] - (v == less))
        left -= take * v
        k = bisect_right(values, left, 0, k - 1)
    return room - left


def pack_shard(lengths: np.ndarray, sizes: Sequence[int], quad: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Bin of each piece, downsized capacity of each bin, and their cost. lengths must descend.

    Open bins are kept by room left, so a piece costs a binary search over at most max(sizes) rooms. Among bins with equal room the latest is taken.
    """
    cost = [bin_cost(c, quad) for c in sizes]
    items = lengths.tolist()
    count = Counter(items)
    values = sorted(count)
    rooms: list[int] = []
    at_room: dict[int, list[int]] = {}
    where, filled = np.empty(len(items), np.int32), []
    for i, n in enumerate(items):
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            stack = at_room[room]
            b = stack.pop()
            if not stack:
                del at_room[room], rooms[k]
        else:
            best = None
            for c in sizes[bisect_left(sizes, n) :]:
                holds = n + fill(c - n, values, count, n)
                per_token = cost[bisect_left(sizes, holds)] / holds
                if best is None or per_token < best[0] - 1e-12:
                    best = per_token, c
            room, b = best[1], len(filled)
            filled.append(0)
        count[n] -= 1
        if not count[n]:
            values.pop()  # pieces come in descending length
        where[i] = b
        filled[b] += n
        left = room - n
        if left:
            if left in at_room:
                at_room[left].append(b)
            else:
                at_room[left] = [b]
                insort(rooms, left)
    pick = np.searchsorted(sizes, filled)
    return where, np.array(sizes)[pick], float(np.array(cost)[pick].sum())


def _pack(key: tuple, rows: pd.DataFrame, sizes: tuple[int, ...], quad: float) -> pd.DataFrame:
    top = sizes[-1]
    n = rows["n_tokens"].to_numpy(np.int64)
    pieces = np.maximum(1, -(-n // top))
    src = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(src)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(top, n[src] - piece * top)
    null = rows["doc_id"].isna().to_numpy()
    ids = rows["doc_id"].fillna(0).to_numpy(np.int64)
    order = np.lexsort((piece, ids[src], ~null[src], -size))
    src, piece, size = src[order], piece[order], size[order]
    where, capacity, _ = pack_shard(size, sizes, quad)
    by_bin = np.argsort(where, kind="stable")
    run = np.cumsum(size[by_bin]) - size[by_bin]
    first = np.searchsorted(where[by_bin], np.arange(len(capacity)))
    offset = np.empty(len(size), np.int64)
    offset[by_bin] = run - run[first][where[by_bin]]
    doc = pd.Series(ids[src], dtype="Int64")
    doc[null[src]] = pd.NA
    return pd.DataFrame({"doc_id": doc, "piece": piece, "start": piece * top, "n_tokens": size, "shard": key[0], "bin": where, "capacity": capacity[where], "bin_offset": offset})


def best_fit_pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, n_tokens: Column | None = None, docs_per_shard: int = 4096, quad: float = 32768.0, seed: int = 11) -> DataFrame:
    """One row per piece: where it starts in its document, its bin (shard, bin), that bin's final capacity, its offset there.

    n_tokens: tokens of a row, at least 1; by default its words and an end token. Only ids and lengths are shuffled.
    """
    sizes = tuple(sorted(set(lengths)))
    size = F.greatest(F.lit(1), n_tokens if n_tokens is not None else word_count(F.col("text")) + 1).cast("long")
    items = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_tokens")), shared_dir(docs.sparkSession, "packing"))
    n_shards = max(1, -(-items.count() // docs_per_shard))
    keys = ["doc_id", "n_tokens"]
    heavy = items.groupBy(*keys).count().where(F.col("count") > docs_per_shard).select(F.col("doc_id").alias("_id"), F.col("n_tokens").alias("_n"))
    if n_heavy := heavy.count():  # fewer than n_shards
        heavy = F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
        items = items.withColumn("row", F.monotonically_increasing_id())
        items = items.join(heavy, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n_tokens") == F.col("_n")), "left").withColumn("salt", F.when(F.col("_n").isNotNull(), F.col("row")))
    else:
        items = items.withColumn("salt", F.lit(None).cast("long"))
    shard = F.pmod(key_hash("doc_id", "n_tokens", F.coalesce("salt", F.lit(-1)), seed=seed), F.lit(n_shards))
    return items.select(*keys, shard.cast("long").alias("shard")).groupBy("shard").applyInPandas(lambda key, rows: _pack(key, rows, sizes, quad), SCHEMA)
