"""Space-partitioning trees over a field of bins: middle splits, entropy-driven splits, histogram-distance splits.

A tree is built level by level: the open nodes (their boxes) are rows, cells meet the boxes that hold them, and one aggregation gives the histograms of all nodes and
candidates of a level. The nodes are small (their number is bounded by the depth) and are sent to the cells; cells never reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .entropy import entropy_of

Box = tuple[tuple[int, int, int], tuple[int, int, int]]
#: Split positions that the searching modes try, as fractions of the box.
FRACTIONS = tuple(0.2 + 0.05 * i for i in range(13))
MODES = ("octree", "quadtree", "kd_middle", "kd_middle_2d", "max_entropy", "sum_entropy", "distance")


def middle(lo: int, hi: int) -> int:
    return math.floor((lo + hi) / 2)


def octants(box: Box) -> list[Box]:
    """Eight children that share their boundary: counter-clockwise in x, y from the low corner, low z first."""
    (lx, ly, lz), (hx, hy, hz) = box
    mx, my, mz = middle(lx, hx), middle(ly, hy), middle(lz, hz)
    square = [((lx, ly), (mx, my)), ((mx, ly), (hx, my)), ((mx, my), (hx, hy)), ((lx, my), (mx, hy))]
    return [((*a, z0), (*b, z1)) for z0, z1 in ((lz, mz), (mz, hz)) for a, b in square]


def quadrants(box: Box) -> list[Box]:
    """Four children in x and y; the whole of z."""
    return [((*lo[:2], box[0][2]), (*hi[:2], box[1][2])) for lo, hi in octants(box)[:4]]


def halves(box: Box, axis: int, at: int) -> list[Box]:
    lo, hi = box
    cut = lambda t, v: tuple(v if i == axis else c for i, c in enumerate(t))
    return [(lo, cut(hi, at)), (cut(lo, at), hi)]


def candidates(box: Box, axes: Sequence[int]) -> list[tuple[int, int, float, list[Box]]]:
    """(axis, fraction's index, fraction, children) of all trial splits."""
    return [(a, i, f, halves(box, a, math.floor(box[0][a] + f * (box[1][a] - box[0][a]) + 1e-9))) for a in axes for i, f in enumerate(FRACTIONS)]


def boxes(spark: SparkSession, rows: Sequence[tuple[int, Box]]) -> DataFrame:
    return spark.createDataFrame([(k, *b[0], *b[1]) for k, b in rows], "key int, lx int, ly int, lz int, hx int, hy int, hz int")


def in_boxes(bins: DataFrame, spark: SparkSession, rows: Sequence[tuple[int, Box]]) -> DataFrame:
    """Cells with the key of each closed box that holds them. The open boxes of a level are few and are sent to the cells."""
    inside = F.lit(True)
    for c in "xyz":
        inside &= F.col(c).between(F.col(f"l{c}"), F.col(f"h{c}"))
    return bins.join(F.broadcast(boxes(spark, rows)), inside)


def box_histograms(bins: DataFrame, spark: SparkSession, rows: Sequence[tuple[int, Box]]) -> DataFrame:
    """key, bin, n of closed boxes."""
    return in_boxes(bins, spark, rows).groupBy("key", "bin").agg(F.count("*").alias("n"))


def slice_histograms(bins: DataFrame, spark: SparkSession, nodes: Sequence[tuple[int, Box]], parts: Sequence[tuple[int, int, int, int, int]]) -> DataFrame:
    """key, bin, n of parts (key, node, axis, lo, hi) that cut a node along one axis.

    Cells are counted once per axis into (node, axis, coordinate, bin) profiles; the many trial parts then only add up profile rows.
    """
    axes = sorted({p[2] for p in parts})
    each = in_boxes(bins, spark, nodes).withColumnRenamed("key", "node").withColumn("t", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col("xyz"[a]).alias("c")) for a in axes])))
    profile = each.groupBy("node", "t.axis", "t.c", "bin").agg(F.count("*").alias("n"))
    trial = F.broadcast(spark.createDataFrame(list(parts), "key int, node int, axis int, lo int, hi int"))
    return profile.join(trial, ["node", "axis"]).where(F.col("c").between(F.col("lo"), F.col("hi"))).groupBy("key", "bin").agg(F.sum("n").alias("n"))


def entropies(hist: DataFrame, normalize: int | None = None) -> dict[int, tuple[float, int]]:
    """Entropy and number of cells of each key."""
    out = hist.groupBy("key").agg(entropy_of("n", normalize).alias("h"), F.sum("n").alias("n"))
    return {r["key"]: (r["h"], r["n"]) for r in out.collect()}


def distances(hist: DataFrame, n_bins: int) -> dict[int, float]:
    """L1 distance of each key's normalised histogram from the uniform one."""
    total = hist.groupBy("key").agg(F.sum("n").alias("t"), F.count("*").alias("kinds"))
    d = F.sum(F.abs(F.col("n") / F.col("t") - 1.0 / n_bins)) + (n_bins - F.first("kinds")) / n_bins
    return {r["key"]: r["d"] for r in hist.join(total, "key").groupBy("key").agg(d.alias("d")).collect()}


def minima(curve: Sequence[float], eps: float = 1e-5) -> list[int]:
    """Positions where the differences turn from falling to rising."""
    diff = [b - a for a, b in zip(curve, curve[1:])]
    sign = [1 if d >= eps else -1 for d in diff]
    return [i for i in range(1, len(sign)) if sign[i] == 1 and sign[i - 1] == -1]


class Tree:
    """nodes: dicts of id, parent, level, path, box, entropy, cells; children in the order of their creation."""

    def __init__(self, nodes: list[dict]):
        self.nodes = nodes

    def frame(self, spark: SparkSession) -> DataFrame:
        """node_id (preorder), parent_id, level, bounds, cells, entropy, is_leaf."""
        order = sorted(self.nodes, key=lambda n: n["path"])
        number = {n["path"]: i for i, n in enumerate(order)}
        parents = {n["path"][:-1] for n in order if n["path"]}
        rows = [(i, number[n["path"][:-1]] if n["path"] else None, n["level"], *n["box"][0], *n["box"][1], n["cells"], n["entropy"], n["path"] not in parents) for i, n in enumerate(order)]
        return spark.createDataFrame(rows, "node_id int, parent_id int, level int, lx int, ly int, lz int, hx int, hy int, hz int, cells long, entropy double, is_leaf boolean")

    def leaves(self, spark: SparkSession) -> DataFrame:
        return self.frame(spark).where("is_leaf")


def volume(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    out = F.lit(1)
    for a, b in zip(lo, hi):
        out = out * (b - a + 1)
    return out


def build(bins: DataFrame, box: Box, mode: str, n_bins: int, max_level: int, min_cells: int = 2, score: Callable[[float, float], float] | None = None, axes: Sequence[int] | None = None) -> Tree:
    """Splits boxes to max_level; a box of fewer than min_cells cells, or that no split makes smaller, is a leaf. bins: x, y, z, bin.

    max_entropy and sum_entropy keep the candidate with the largest (max or sum of the children's entropies); distance splits at the deepest local minimum of the histogram distance along an axis and
    stops where there is none. score replaces the rule of the entropy modes.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    spark = bins.sparkSession
    h, n = entropies(box_histograms(bins, spark, [(0, box)])).get(0, (0.0, 0))
    nodes = [{"path": (), "level": 0, "box": box, "entropy": h, "cells": n}]
    open_ = nodes[:]
    for level in range(max_level):
        chosen: list[tuple[dict, list[Box]]] = []
        alive = [p for p in open_ if p["cells"] >= min_cells]
        if not alive:
            break
        if mode == "octree":
            chosen = [(p, octants(p["box"])) for p in alive]
        elif mode == "quadtree":
            chosen = [(p, quadrants(p["box"])) for p in alive]
        elif mode in ("kd_middle", "kd_middle_2d"):
            axis = level % (3 if mode == "kd_middle" else 2)
            chosen = [(p, halves(p["box"], axis, middle(p["box"][0][axis], p["box"][1][axis]))) for p in alive]
        else:
            use = axes or ((0, 1) if mode != "distance" else (0, 1, 2))
            trials = [(p, c) for p in alive for c in candidates(p["box"], use)]
            number = {id(p): i for i, p in enumerate(alive)}
            parts = [(2 * i + k, number[id(p)], c[0], b[0][c[0]], b[1][c[0]]) for i, (p, c) in enumerate(trials) for k, b in enumerate(c[3])]
            hist = slice_histograms(bins, spark, [(i, p["box"]) for i, p in enumerate(alive)], parts)
            if mode == "distance":
                value = distances(hist, n_bins)
                chosen = [x for p in alive if (x := _deepest(p, [(i, c) for i, (q, c) in enumerate(trials) if q is p], value))]
            else:
                value = {k: v[0] for k, v in entropies(hist).items()}
                rule = score or (max if mode == "max_entropy" else lambda a, b: a + b)
                for p in alive:
                    own = [(rule(value.get(2 * i, 0.0), value.get(2 * i + 1, 0.0)), -i) for i, (q, _) in enumerate(trials) if q is p]
                    chosen.append((p, trials[-max(own)[1]][1][3]))
        chosen = [(p, kids) for p, kids in chosen if all(k != p["box"] for k in kids)]
        flat = [(p, i, b) for p, kids in chosen for i, b in enumerate(kids)]
        if not flat:
            break
        value = entropies(box_histograms(bins, spark, [(i, b) for i, (_, _, b) in enumerate(flat)]))
        open_ = [{"path": (*p["path"], k), "level": level + 1, "box": b, "entropy": value.get(i, (0.0, 0))[0], "cells": value.get(i, (0.0, 0))[1]} for i, (p, k, b) in enumerate(flat)]
        nodes += open_
    return Tree(nodes)


def _deepest(node: dict, trials: list[tuple[int, tuple]], value: dict[int, float]) -> tuple[dict, list[Box]] | None:
    best = None
    for axis in sorted({c[0] for _, c in trials}):
        along = [(i, c) for i, c in trials if c[0] == axis]
        for side in (0, 1):
            curve = [value.get(2 * i + side, 2.0) for i, _ in along]
            for m in minima(curve):
                if best is None or curve[m] < best[0]:
                    best = curve[m], along[m][1][3]
    return best and (node, best[1])
