"""Trees of several levels against a recursion in numpy on the smallest tables."""

import math

import numpy as np
import pytest

from entrofield.plans import registry

FRACTIONS = [0.2 + 0.05 * i for i in range(13)]


@pytest.fixture(scope="module")
def bins(spark, sf):
    """Bins [x, y, z] of the event grid."""
    v = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").toPandas().sort_values("event_id").value.to_numpy()
    b = np.clip(np.floor((v - v.min()) / ((v.max() - v.min()) / 16)), 0, 15).astype(int)
    return b.reshape(-1, 10, 10).transpose(2, 1, 0)


def entropy(bins, box):
    n = np.bincount(bins[tuple(slice(a, b + 1) for a, b in zip(*box))].ravel())
    p = n[n > 0] / n.sum()
    return -(p * np.log2(p)).sum()


def cut(box, axis, at):
    (lo, hi), put = box, lambda t: tuple(at if i == axis else c for i, c in enumerate(t))
    return [(lo, put(hi)), (put(lo), hi)]


def split(bins, box, mode, level):
    mid = [(a + b) // 2 for a, b in zip(*box)]
    if mode == "quadtree":
        left, right = cut(box, 0, mid[0])
        (a, d), (b, c) = cut(left, 1, mid[1]), cut(right, 1, mid[1])
        return [a, b, c, d]
    if mode == "kd_middle":
        return cut(box, level % 3, mid[level % 3])
    trials = [cut(box, a, math.floor(box[0][a] + f * (box[1][a] - box[0][a]) + 1e-9)) for a in (0, 1) for f in FRACTIONS]
    rule = max if mode == "max_entropy" else sum
    value = [rule([entropy(bins, k) for k in kids]) for kids in trials]
    return trials[next(i for i, v in enumerate(value) if v >= max(value) - 1e-12)]


def grow(bins, box, mode, levels, level=0):
    rows = [(level, *box[0], *box[1], entropy(bins, box))]
    size = np.prod([b - a + 1 for a, b in zip(*box)])
    if level < levels and size >= 2:
        kids = split(bins, box, mode, level)
        if all(k != box for k in kids):
            for k in kids:
                rows += grow(bins, k, mode, levels, level + 1)
    return rows


@pytest.mark.parametrize("name, mode, levels", [("p2_quadtree_deep", "quadtree", 3), ("p3_kd_middle_deep", "kd_middle", 4), ("p4_max_entropy_split_deep", "max_entropy", 3), ("p5_sum_entropy_split_deep", "sum_entropy", 3)])
def test_deep_tree(spark, sf, bins, name, mode, levels):
    want = grow(bins, ((0, 0, 0), tuple(n - 1 for n in bins.shape)), mode, levels)
    got = registry.QUERIES[name](spark, sf).toPandas().sort_values("node_id")
    assert got.level.max() == levels and len(got) == len(want)
    for g, w in zip(got[["level", "lx", "ly", "lz", "hx", "hy", "hz", "entropy"]].itertuples(index=False), want):
        assert tuple(g)[:7] == w[:7] and abs(g.entropy - w[7]) < 2e-6, (g, w)
