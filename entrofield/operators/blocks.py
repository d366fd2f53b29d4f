"""Blocks of a grid: decompositions, shared boundaries, ghost cells, per-block reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entropy import counts, from_counts
from .grid import GridSpec


def _size(n: int, parts: int, split: str) -> int:
    return max(1, n // parts if split == "floor" else -(-n // parts))


def block_index(v: Column, n: int, parts: int, split: str = "ceil") -> Column:
    """Block of an index along an axis: equal sizes (ceil), or floor sizes with the rest in the last block."""
    return F.least(F.floor(v / _size(n, parts, split)), F.lit(parts - 1)).cast("int")


def with_block(df: DataFrame, grid: GridSpec, parts: Sequence[int], split: str = "ceil") -> DataFrame:
    """Adds bx, by, bz and block_id (x fastest); every cell in one block."""
    idx = [block_index(F.col(c) - l, n, p, split) for c, l, n, p in zip("xyz", grid.low, grid.dims, parts)]
    out = df.withColumns(dict(zip(("bx", "by", "bz"), idx)))
    return out.withColumn("block_id", ((F.col("bz") * parts[1] + F.col("by")) * parts[0] + F.col("bx")).cast("int"))


def shared_blocks(df: DataFrame, grid: GridSpec, parts: Sequence[int]) -> DataFrame:
    """Blocks of ceil((n - 1) / parts) steps whose boundary cells belong to both neighbours: such a row appears once per block."""
    for c, l, n, p in zip("xyz", grid.low, grid.dims, parts):
        size = max(1, -(-(n - 1) // p))
        v = F.col(c) - l
        at = F.least(F.floor(v / size), F.lit(p - 1)).cast("int")
        both = (v % size == 0) & (v > 0) & (F.floor(v / size) <= p - 1)
        df = df.withColumn(f"b{c}", F.explode(F.when(both, F.array(at - 1, at)).otherwise(F.array(at))))
    return df.withColumn("block_id", ((F.col("bz") * parts[1] + F.col("by")) * parts[0] + F.col("bx")).cast("int"))


def ghost_blocks(df: DataFrame, grid: GridSpec, parts: Sequence[int], ghost: int | Sequence[int] = 1, split: str = "ceil") -> DataFrame:
    """Each block's cells with `ghost` layers of its neighbours in all 26 directions: block_id, is_ghost, direction (offset of the owner as -1, 0, 1 per axis)."""
    g = (ghost,) * 3 if isinstance(ghost, int) else tuple(ghost)
    dirs = []
    for c, l, n, p, k in zip("xyz", grid.low, grid.dims, parts, g):
        size, v = _size(n, p, split), F.col(c) - l
        if k > size:
            raise ValueError("ghost layers are wider than a block")
        own = block_index(v, n, p, split)
        start, end = own * size, F.when(own == p - 1, F.lit(n - 1)).otherwise(own * size + size - 1)
        left = F.when((v - start < k) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<int>"))
        right = F.when((end - v < k) & (own < p - 1), F.array(own + 1)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn(f"o{c}", own).withColumn(f"b{c}", F.explode(F.concat(F.array(own), left, right)))
        dirs.append(F.col(f"o{c}") - F.col(f"b{c}"))
    df = df.withColumn("block_id", ((F.col("bz") * parts[1] + F.col("by")) * parts[0] + F.col("bx")).cast("int"))
    return df.withColumn("direction", F.array(*dirs)).withColumn("is_ghost", F.exists("direction", lambda d: d != 0)).drop("ox", "oy", "oz")


def block_limits(df: DataFrame) -> DataFrame:
    """block_id and its least and largest cell per axis."""
    return df.groupBy("block_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


def block_report(binned: DataFrame, n_bins: int, normalize: bool = False) -> DataFrame:
    """block_id, limits, entropy, and the dense normalised histogram as an array; a block's histogram has n_bins entries whatever its cells."""
    hist = counts(binned, ["block_id"])
    total = hist.groupBy("block_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # at most n_bins entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)) / F.col("total"))
    freq = total.select("block_id", dense.alias("freq"))
    h = from_counts(hist, ["block_id"], n_bins if normalize else None)
    return block_limits(binned).join(h, "block_id").join(freq, "block_id")


def with_global_ids(df: DataFrame, mapping: DataFrame, one_based: bool = False) -> DataFrame:
    """Replaces block_id by the global id of a (block_id, global_id) table; one_based for Fortran callers."""
    m = mapping.select((F.col("block_id") - int(one_based)).alias("block_id"), (F.col("global_id") - int(one_based)).alias("global_id"))
    return df.join(m, "block_id").drop("block_id").withColumnRenamed("global_id", "block_id")
