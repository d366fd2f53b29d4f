"""Local entropy: for each cell, the entropy of the bins in the box of cells around it.

The grid is cut into blocks, cells are replicated into the halos they belong to (about (1 + 2 radius / block) ** 3 rows per cell are shuffled), and each block is evaluated with numpy: by
running sums along the axes, one bin after another, whose cost does not depend on the radius; or, where a block has more bins than a box has cells, by sorting the bins of each
box. Boundary cells appear in a box as often as the boundary rule repeats them. exploded() says the same with DataFrame operations only, at a row per cell and box: a second
opinion for tests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entropy import entropy_of
from .grid import GridSpec

#: Values of boxes that are sorted at once.
SORTED = 1 << 21
MODES = ("mirror", "reflect", "clamp")
#: What is added to 2 * last - i beyond the high side: mirror skips a cell there.
HIGH = {"mirror": -1, "reflect": 1}


def padded(n: int, r: int, mode: str) -> np.ndarray:
    """Source index of each position -r .. n - 1 + r of an axis."""
    if mode not in MODES:
        raise ValueError(f"unknown boundary {mode!r}")
    if mode != "clamp" and n < r + 2:
        raise ValueError(f"an axis of {n} cells is too short for radius {r}")
    i, last = np.arange(-r, n + r), n - 1
    if mode == "clamp":
        return np.clip(i, 0, last)
    return np.where(i < 0, -i - 1, np.where(i > last, 2 * last - i + HIGH[mode], i))


def _reach(n: int, r: int, mode: str) -> list[tuple[int, int]]:
    """(source, target) pairs of an axis: which centres a cell counts for, with repetition."""
    src = padded(n, r, mode)
    return [(int(src[c + k]), c) for c in range(n) for k in range(2 * r + 1)]


def local_entropy(bins: DataFrame, grid: GridSpec, radius: int | tuple[int, int, int], n_bins: int, normalize: bool = False, mode: str = "mirror", block: int = 32) -> DataFrame:
    """cell_id, x, y, z, entropy for every cell of a dense grid. bins: x, y, z, bin."""
    r = (radius,) * 3 if isinstance(radius, int) else tuple(radius)
    size = math.prod(2 * k + 1 for k in r)
    for n, k in zip(grid.dims, r):
        padded(n, k, mode)
    local = bins.select(*[(F.col(c) - l).cast("int").alias(c) for c, l in zip("xyz", grid.low)], F.col("bin").cast("int").alias("bin"))
    out = _blocks(local, grid, r, size, n_bins, normalize, mode, block)
    return out.select(*[(F.col(c) + l).cast("int").alias(c) for c, l in zip("xyz", grid.low)], "entropy").select(grid.cell_id(F.col("x"), F.col("y"), F.col("z")).alias("cell_id"), "x", "y", "z", "entropy")


def _targets(name: str, n: int, r: int, mode: str):
    """Array of the centres along one axis that a cell counts for: plain arithmetic inside, repeated at the edges."""
    v, last = F.col(name), n - 1
    inner = F.sequence(F.greatest(v - r, F.lit(0)), F.least(v + r, F.lit(last)))
    # centre c reads padded position c + k; position p < 0 or > last stands for one more cell
    extra = [F.filter(F.sequence(F.lit(0), F.lit(min(last, r - 1))), lambda c: (v <= r - 1 - c) & (v >= 0))] if r and mode != "clamp" else []
    if r and mode != "clamp":
        shift = HIGH[mode]
        # p = 2 * last - v + shift lies in last + 1 .. c + r
        p = 2 * last - v + shift
        extra.append(F.filter(F.sequence(F.lit(max(0, last - r)), F.lit(last)), lambda c: (p > last) & (p <= c + r)))
    if r and mode == "clamp":
        low = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(min(last, r - 1))), lambda c: F.array_repeat(c, F.lit(r) - c)))
        high = F.flatten(F.transform(F.sequence(F.lit(max(0, last - r + 1)), F.lit(last)), lambda c: F.array_repeat(c, c + r - last)))
        none = F.array().cast("array<int>")
        extra = [F.when(v == 0, low).otherwise(none), F.when(v == last, high).otherwise(none)]
    return F.concat(inner, *extra) if extra else inner


def exploded(bins: DataFrame, grid: GridSpec, r: tuple, size: int, n_bins: int, normalize: bool, mode: str) -> DataFrame:
    df = bins
    for name, n, k in zip("xyz", grid.dims, r):
        df = df.withColumn(name, F.explode(_targets(name, n, k, mode)))
    hist = df.groupBy("x", "y", "z", "bin").agg(F.count("*").alias("n"))
    return hist.groupBy("x", "y", "z").agg(entropy_of("n", n_bins if normalize else None).alias("entropy"))


def halo(bins: DataFrame, grid: GridSpec, r: tuple, mode: str, block: int) -> DataFrame:
    """bx, by, bz, px, py, pz, bin: each block's cells with their halo, positions counted from the block's padded corner; boundary cells are repeated."""
    df = bins
    for name, n, k in zip("xyz", grid.dims, r):
        src = padded(n, k, mode)
        places: dict[int, list[tuple[int, int]]] = {}
        edge = {int(s) for s in np.concatenate([src[:k], src[n + k :]])} if k else set()
        for p, s in enumerate(src):
            if int(s) in edge:
                places.setdefault(int(s), []).append(p)
        # padded positions of a cell: its own and, near the faces, those that repeat it (at most a few per axis)
        own = F.array(F.col(name) + k)
        for s, ps in places.items():
            own = F.when(F.col(name) == s, F.array(*[F.lit(int(p)) for p in ps])).otherwise(own)
        df = df.withColumn("_p", F.explode(own))
        # a padded position p belongs to blocks b with b * block <= p < b * block + block + 2k
        first = F.greatest(F.lit(0), F.ceil((F.col("_p") - (block + 2 * k) + 1) / block)).cast("int")
        last = F.least(F.lit((n - 1) // block), F.floor(F.col("_p") / block)).cast("int")
        df = df.withColumn(f"b{name}", F.explode(F.sequence(first, last))).withColumn(f"p{name}", (F.col("_p") - F.col(f"b{name}") * block).cast("int")).drop("_p")
    return df.select("bx", "by", "bz", "px", "py", "pz", "bin")


def box_entropy(a: np.ndarray, r: tuple, n_bins: int, normalize: bool) -> np.ndarray:
    """Entropy of the box around every inner cell of a padded array of bins (z, y, x); one bin after another, by running sums."""
    size = math.prod(2 * k + 1 for k in r)
    out = 0.0
    for b in np.unique(a):
        c = (a == b).astype(np.float32)
        for axis, k in zip((2, 1, 0), r):
            s = np.cumsum(c, axis=axis, dtype=np.float32 if size < 1 << 22 else np.float64)
            w = 2 * k + 1
            hi = np.take(s, np.arange(w - 1, s.shape[axis]), axis)
            lo = np.take(s, np.arange(0, s.shape[axis] - w), axis)
            c = hi
            c[tuple(slice(1, None) if i == axis else slice(None) for i in range(3))] -= lo
        p = np.round(c).astype(np.float64) / size
        out = out - np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)
    return out / math.log2(n_bins) if normalize and n_bins > 1 else out * (0 if normalize and n_bins == 1 else 1)


def sorted_entropy(a: np.ndarray, r: tuple, n_bins: int, normalize: bool) -> np.ndarray:
    """As box_entropy(), by the runs of equal bins in each sorted box; for many bins and small boxes."""
    size = math.prod(2 * k + 1 for k in r)
    boxes = np.lib.stride_tricks.sliding_window_view(a, tuple(2 * k + 1 for k in r[::-1]))
    shape = boxes.shape[:3]
    cost = np.arange(size + 1) * np.log2(np.maximum(np.arange(size + 1), 1))
    out = np.empty(math.prod(shape))
    per = max(1, SORTED // size)
    for i in range(0, len(out), per):
        at = np.unravel_index(np.arange(i, min(len(out), i + per)), shape)
        rows = np.sort(boxes[at].reshape(len(at[0]), size), axis=1)
        new = np.ones(rows.shape, bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        begin = np.flatnonzero(new)
        runs = np.diff(np.append(begin, rows.size))
        first = np.flatnonzero(begin % size == 0)
        out[i : i + len(rows)] = math.log2(size) - np.add.reduceat(cost[runs], first) / size
    out = np.maximum(out, 0).reshape(shape)
    return out / math.log2(n_bins) if normalize and n_bins > 1 else out * (0 if normalize and n_bins == 1 else 1)


def _blocks(bins: DataFrame, grid: GridSpec, r: tuple, size: int, n_bins: int, normalize: bool, mode: str, block: int) -> DataFrame:
    dims = grid.dims

    def evaluate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [min(block, n - k * block) for n, k in zip(dims, key)]
        shape = tuple(o + 2 * k for o, k in zip(own, r))
        a = np.full(shape[::-1], -1, np.int32)
        inside = (rows["px"] < shape[0]) & (rows["py"] < shape[1]) & (rows["pz"] < shape[2])
        rows = rows[inside]
        a[rows["pz"], rows["py"], rows["px"]] = rows["bin"]
        kinds = int(np.count_nonzero(np.bincount(rows["bin"])))
        h = (sorted_entropy if kinds > size else box_entropy)(a, r, n_bins, normalize)
        z, y, x = np.meshgrid(*[np.arange(o) + k * block for o, k in zip(own[::-1], key[::-1])], indexing="ij")
        return pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "entropy": h.ravel()})

    return halo(bins, grid, r, mode, block).groupBy("bx", "by", "bz").applyInPandas(evaluate, "x int, y int, z int, entropy double")
