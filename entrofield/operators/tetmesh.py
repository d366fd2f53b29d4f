"""Tetrahedral meshes: bounding boxes, adjacency, exact isovolume histograms, and entropies.

vertices: vid, x, y, z, f. cells: cid, v (array of 4 vertex ids). The distribution of a linear field over a tetrahedron is a quadratic B-spline whose knots are the four vertex
values; its three quadratics are integrated over each bin in closed form. Weighted by volume it tells how much of the cell lies in the bin; by area (of isosurfaces) that times the gradient.

Spark takes an exploded table for as small as what it is made from. Joins with one are therefore told to merge: else it would be broadcast, and pass the driver, for meshes of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cross, dot, magnitude, scale, sub
from .entropy import from_counts

#: Pairs of a cell and a bin, and of a cell and a vertex, that are evaluated at once.
PARTS, PAIRS = 1 << 18, 1 << 10
FACES = ((1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2))


def with_corners(vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """cid and corners: array of 4 structs (x, y, z, f) in the order of v."""
    each = cells.select("cid", F.posexplode("v").alias("i", "vid")).join(vertices.hint("merge"), "vid")
    return each.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z", "f"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), c["f"].alias("f"))).alias("corners"))


def bounding_boxes(meshed: DataFrame, *keep: str) -> DataFrame:
    """cid, lx, hx, ... of corners, and the columns to keep."""
    return meshed.select("cid", *keep, *[f(F.col(f"corners.{n}")).alias(f"{p}{n}") for n in "xyz" for p, f in (("l", F.array_min), ("h", F.array_max))])


def vertex_cells(cells: DataFrame) -> DataFrame:
    """vid, cid of cells around each vertex."""
    return cells.select(F.explode("v").alias("vid"), "cid")


def face_neighbours(cells: DataFrame) -> DataFrame:
    """cid, face, other: cells that share a face (its three vertex ids, sorted). A face has at most two cells, so groups are pairs."""
    faces = cells.select("cid", F.posexplode(F.array(*[F.array_sort(F.array(*[F.col("v")[i] for i in f])) for f in FACES])).alias("face", "key"))
    keyed = faces.select("cid", "face", *[F.col("key")[i].alias(f"k{i}") for i in range(3)])
    each = keyed.groupBy("k0", "k1", "k2").agg(F.collect_list(F.struct("cid", "face")).alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("a"), "all")
    return each.select("a", F.explode("all").alias("b")).where("a.cid <> b.cid").select("a.cid", "a.face", F.col("b.cid").alias("other"))


def intersects(v: str = "v", b: str = "b") -> Column:
    """Open boxes meet."""
    out = F.lit(True)
    for c in "xyz":
        out &= (F.col(f"{v}.l{c}") < F.col(f"{b}.h{c}")) & (F.col(f"{v}.h{c}") > F.col(f"{b}.l{c}"))
    return out


def contains(v: str = "v", b: str = "b") -> Column:
    """Box v holds box b, boundaries included."""
    out = F.lit(True)
    for c in "xyz":
        out &= (F.col(f"{v}.l{c}") <= F.col(f"{b}.l{c}")) & (F.col(f"{v}.h{c}") >= F.col(f"{b}.h{c}"))
    return out


def box_relation(vertices: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """vid, cid, contained for the cells whose box meets the box of a radius around a vertex."""
    return _met(vertices, boxes, radius).select("v.vid", "b.cid", contains().alias("contained"))


def _met(vertices: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """Vertices with their boxes (v) and, with all their columns, the boxes that meet them (b).

    Both sides are dealt to cubes of twice the radius; a pair is kept in the cube of its lowest common corner, so it appears once.
    """
    side = 2 * radius
    box = vertices.select("vid", *"xyz", *[e.alias(n) for c in "xyz" for n, e in ((f"l{c}", F.col(c) - radius), (f"h{c}", F.col(c) + radius))])

    def dealt(df: DataFrame) -> DataFrame:
        for c in "xyz":
            df = df.withColumn(f"g{c}", F.explode(F.sequence(F.floor(F.col(f"l{c}") / side), F.floor(F.col(f"h{c}") / side))))
        return df

    v, b = dealt(box).alias("v"), dealt(boxes).hint("merge").alias("b")
    on = [F.col(f"v.g{c}") == F.col(f"b.g{c}") for c in "xyz"]
    first = [F.col(f"v.g{c}") == F.floor(F.greatest(f"v.l{c}", f"b.l{c}") / side) for c in "xyz"]
    cond = intersects()
    for e in (*on, *first):
        cond &= e
    return v.join(b, cond)


# ---------------------------------------------------------------- the spline


def ordered(corners: Column) -> Column:
    """Corners by ascending value."""
    return F.array_sort(F.transform(corners, lambda c: F.struct(c["f"].alias("f"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"))))


def volume_and_gradient(corners: Column) -> tuple[Column, Column]:
    """Volume and gradient's length of the linear field; a flat cell has volume 0 and gradient 0."""
    p = [[corners[i][c] for c in "xyz"] for i in range(4)]
    e = [sub(p[i], p[0]) for i in (1, 2, 3)]
    d = [corners[i]["f"] - corners[0]["f"] for i in (1, 2, 3)]
    n = [cross(e[1], e[2]), cross(e[2], e[0]), cross(e[0], e[1])]
    det = dot(e[0], n[0])
    g = [sum((scale(v, df)[k] for v, df in zip(n, d)), F.lit(0.0)) for k in range(3)]
    return F.abs(det) / 6, F.when(det == 0, F.lit(0.0)).otherwise(magnitude(g) / F.abs(det))


def cross_section(sorted_corners: Column, at: int) -> Column:
    """Area of the isosurface through the second (1) or third (2) vertex: the triangle it forms with two points on opposite edges."""
    c = sorted_corners

    def on_edge(i: int, j: int, f: Column) -> list[Column]:
        t = F.when(c[j]["f"] == c[i]["f"], F.lit(0.0)).otherwise((f - c[i]["f"]) / (c[j]["f"] - c[i]["f"]))
        return [c[i][k] + t * (c[j][k] - c[i][k]) for k in "xyz"]

    f = c[at]["f"]
    a = on_edge(0, 2, f) if at == 1 else on_edge(1, 3, f)
    b = on_edge(0, 3, f)
    p = [c[at][k] for k in "xyz"]
    return magnitude(cross(sub(a, p), sub(b, p))) / 2


def spline(f: list[Column]) -> list[list[Column]]:
    """a, b, c of a t^2 + b t + c for the three pieces between the knots f0 <= f1 <= f2 <= f3; the density has unit integral. Empty pieces are 0."""

    def safe(d: Column) -> Column:
        return F.when(d == 0, F.lit(0.0)).otherwise(1 / d)

    f0, f1, f2, f3 = f
    k1 = 3 * safe((f1 - f0) * (f2 - f0) * (f3 - f0))
    k3 = 3 * safe((f3 - f0) * (f3 - f1) * (f3 - f2))
    u = 3 * safe((f3 - f0) * (f2 - f0) * (f2 - f1))
    w = 3 * safe((f3 - f0) * (f3 - f1) * (f2 - f1))
    return [[k1, -2 * f0 * k1, f0 * f0 * k1], [-(u + w), u * (f0 + f2) + w * (f1 + f3), -(u * f0 * f2 + w * f1 * f3)], [k3, -2 * f3 * k3, f3 * f3 * k3]]


def integral(q: list[Column], lo: Column, hi: Column) -> Column:
    a, b, c = q
    value = a / 3 * (hi * hi * hi - lo * lo * lo) + b / 2 * (hi * hi - lo * lo) + c * (hi - lo)
    return F.when(hi > lo, value).otherwise(0.0)


def contribution(f: list[Column], lo: Column, hi: Column) -> Column:
    """Share of the cell whose value lies in [lo, hi]. Values are taken relative to the least, for the sake of cubes of nearby numbers."""
    g = [x - f[0] for x in f]
    lo, hi = lo - f[0], hi - f[0]
    return sum((integral(q, F.greatest(lo, a), F.least(hi, b)) for q, a, b in zip(spline(g), g, g[1:])), F.lit(0.0))


def _measure(c: np.ndarray, weight: str) -> np.ndarray:
    """Volume of cells (n, corner, xyzf), times the gradient's length for area; as volume_and_gradient()."""
    e, d = c[:, 1:, :3] - c[:, :1, :3], c[:, 1:, 3] - c[:, :1, 3]
    n = np.stack([np.cross(e[:, i], e[:, j]) for i, j in ((1, 2), (2, 0), (0, 1))], 1)
    det = (e[:, 0] * n[:, 0]).sum(1)
    if weight == "volume":
        return np.abs(det) / 6
    return np.abs(det) / 6 * np.divide(np.sqrt(((n * d[..., None]).sum(1) ** 2).sum(1)), np.abs(det), out=np.zeros(len(c)), where=det != 0)


def _bin(v: np.ndarray, n_bins: int, lo: float, hi: float) -> np.ndarray:
    return np.clip(np.floor((v - lo) / ((hi - lo) / n_bins)), 0, n_bins - 1).astype(np.int64) if hi > lo else np.zeros(v.shape, np.int64)


def _pieces(g: list[np.ndarray]) -> list[list[np.ndarray]]:
    """spline() over arrays; the least value is 0."""
    safe = lambda d: np.divide(1, d, out=np.zeros(len(d)), where=d != 0)
    f0, f1, f2, f3 = g
    k1 = 3 * safe((f1 - f0) * (f2 - f0) * (f3 - f0))
    k3 = 3 * safe((f3 - f0) * (f3 - f1) * (f3 - f2))
    u = 3 * safe((f3 - f0) * (f2 - f0) * (f2 - f1))
    w = 3 * safe((f3 - f0) * (f3 - f1) * (f2 - f1))
    return [[k1, -2 * f0 * k1, f0 * f0 * k1], [-(u + w), u * (f0 + f2) + w * (f1 + f3), -(u * f0 * f2 + w * f1 * f3)], [k3, -2 * f3 * k3, f3 * f3 * k3]]


def parts(c: np.ndarray, n_bins: int, weight: str, lo: float, hi: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of a cell (n, corner, xyzf), bin, and what the cell adds to it, for the bins its values overlap. A cell of one value is all in that value's bin (weight volume) or nowhere (area)."""
    step = max(1, PARTS // n_bins)
    for start in range(0, len(c), step):
        some = c[start : start + step]
        m, f = _measure(some, weight), np.sort(some[..., 3], 1)
        g = [f[:, i] - f[:, 0] for i in range(4)]
        first, width = _bin(f[:, 0], n_bins, lo, hi), (hi - lo) / n_bins
        count = _bin(f[:, 3], n_bins, lo, hi) - first + 1
        row = np.repeat(np.arange(len(some)), count)
        b = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - first, count)
        # the outer bins take what lies beyond the range
        low = np.where(b == 0, np.minimum(lo, f[row, 0]), lo + b * width) - f[row, 0]
        high = np.where(b == n_bins - 1, np.maximum(hi, f[row, 3]), lo + (b + 1) * width) - f[row, 0]
        share = np.zeros(len(row))
        for (p, q, r), k in zip(_pieces(g), range(3)):
            x, y = np.maximum(low, g[k][row]), np.minimum(high, g[k + 1][row])
            share += np.where(y > x, p[row] / 3 * (y * y * y - x * x * x) + q[row] / 2 * (y * y - x * x) + r[row] * (y - x), 0)
        yield start + row, b, m[row] * np.where(g[3][row] == 0, 1, share)


def _flat(prefix: str = "corners") -> list[Column]:
    return [F.col(prefix)[i][c].cast("double").alias(f"{c}{i}") for i in range(4) for c in "xyzf"]


def _corners(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[f"{c}{i}"].to_numpy(zero_copy_only=False) for i in range(4) for c in "xyzf"], 1).reshape(-1, 4, 4)


def defined(df: DataFrame, *names: str) -> DataFrame:
    """Rows without null or undefined numbers."""
    for n in names:
        df = df.where(F.col(n).isNotNull() & ~F.isnan(n))
    return df


def cell_contributions(vertices: DataFrame, cells: DataFrame, n_bins: int, weight: str = "area") -> DataFrame:
    """bin, w: what batches of cells add to the bins their values overlap. The range is that of the cells' vertices."""
    if weight not in ("area", "volume"):
        raise ValueError("weight is area or volume")
    vertices = defined(vertices.withColumn("f", F.col("f").cast("double")), *"xyzf")
    used = vertices.join(cells.select(F.explode("v").alias("vid")).distinct().hint("merge"), "vid", "left_semi")
    meshed = with_corners(vertices, cells).where(F.size("corners") == 4).select(*_flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, seen = np.zeros(n_bins), np.zeros(n_bins, bool)
                for _, b, w in parts(_corners(batch), n_bins, weight, batch["lo"][0].as_py(), batch["hi"][0].as_py()):
                    n += np.bincount(b, w, n_bins)
                    seen[b] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32)), pa.array(n[seen])], names=["bin", "w"])

    return meshed.join(F.broadcast(used.agg(F.min("f").alias("lo"), F.max("f").alias("hi")))).mapInArrow(run, "bin int, w double")


def global_histogram(vertices: DataFrame, cells: DataFrame, n_bins: int, weight: str = "area") -> DataFrame:
    return cell_contributions(vertices, cells, n_bins, weight).groupBy("bin").agg(F.sum("w").alias("n"))


def global_entropy(vertices: DataFrame, cells: DataFrame, n_bins: int, weight: str = "area", normalize: bool = False) -> DataFrame:
    return from_counts(global_histogram(vertices, cells, n_bins, weight), (), n_bins if normalize else None)


def local_entropy(vertices: DataFrame, cells: DataFrame, radius: float, n_bins: int, weight: str = "volume", normalize: bool = False, density: int = 10) -> DataFrame:
    """vid, entropy over a box around each vertex: cells inside it count exactly, cells that straddle it by samples on a barycentric lattice of the given density.

    Corners are dealt to the cubes with the cells' boxes, so that pairs are evaluated as they are found; what leaves a batch of them is a histogram of each of its vertices.
    """
    if weight not in ("area", "volume"):
        raise ValueError("weight is area or volume")
    around, vertices = defined(vertices, *"xyz"), defined(vertices.withColumn("f", F.col("f").cast("double")), *"xyzf")
    lo, hi = vertices.agg(F.min("f"), F.max("f")).first()
    lattice = [(i, j, k) for i in range(density) for j in range(density - i) for k in range(density - i - j)]
    bary = np.array([[a, b, c, 1 - a - b - c] for a, b, c in (((i + 0.25) / density, (j + 0.25) / density, (k + 0.25) / density) for i, j, k in lattice)])
    meshed = with_corners(vertices, cells).where(F.size("corners") == 4)
    boxes = bounding_boxes(meshed, "corners").select("*", *_flat()).drop("corners")
    pairs = _met(around, boxes, radius).select("v.vid", *[F.col(f"v.{c}").cast("double").alias(f"v{c}") for c in "xyz"], "b.cid", contains().alias("contained"), *[f"b.{c}{i}" for i in range(4) for c in "xyzf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, of = np.unique(batch["vid"].to_numpy(), return_inverse=True)
            _, first, cell = np.unique(batch["cid"].to_numpy(), return_index=True, return_inverse=True)
            c, at = _corners(batch)[first], np.stack([batch[f"v{n}"].to_numpy() for n in "xyz"])
            inside = batch["contained"].to_numpy(zero_copy_only=False)
            m, codes, weights = _measure(c, weight) / len(bary), [], []
            whole = np.flatnonzero(inside)
            whole = whole[np.argsort(cell[whole], kind="stable")]
            which, begin, count = np.unique(cell[whole], return_index=True, return_counts=True)
            for row, b, w in parts(c[which], n_bins, weight, lo, hi):
                k = count[row]
                pair = whole[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - begin[row], k)]
                codes.append(of[pair] * n_bins + np.repeat(b, k))
                weights.append(np.repeat(w, k))
            points = [sum(c[:, k, i, None] * bary[:, k] for k in range(4)) for i in range(4)]  # in this order: a value on a bin's edge turns on the last digit
            bins, cut = _bin(points[3], n_bins, lo, hi), np.flatnonzero(~inside)
            for i in range(0, len(cut), PAIRS):
                p = cut[i : i + PAIRS]
                u = cell[p]
                near = np.abs(points[0][u] - at[0][p, None]) <= radius
                for axis in (1, 2):
                    near &= np.abs(points[axis][u] - at[axis][p, None]) <= radius
                k, t = np.nonzero(near)
                codes.append(of[p[k]] * n_bins + bins[u[k], t])
                weights.append(m[u[k]])
            if not codes:
                continue
            found, to = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(to, np.concatenate(weights), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(names[found // n_bins]), pa.array((found % n_bins).astype(np.int32)), pa.array(n)], names=["vid", "bin", "w"])

    hist = pairs.mapInArrow(run, "vid long, bin int, w double").groupBy("vid", "bin").agg(F.sum("w").alias("n")).where("n > 0")
    return from_counts(hist, ["vid"], n_bins if normalize else None)
