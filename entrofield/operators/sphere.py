"""Partitions of the sphere: recursive zonal equal-area patches, and the geodesic hierarchy of an icosahedron.

Both are generated for any size on the driver (their size is a parameter) and looked up through tables over both angles: a vector's bin costs one array access.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import direction_angles
from .binning import table_cell

TWO_PI = 2 * math.pi


@lru_cache(maxsize=8)
def equal_area_patches(n: int) -> np.ndarray:
    """theta_lo, theta_hi, phi_lo, phi_hi of n patches of equal area: two caps and zones cut into sectors (Leopardi's partition EQ(2, n)).

    The first sector of each zone is rotated against the zone before by the published circle offset, so sectors may run past 2 pi.
    """
    if n == 1:
        return np.array([[0, TWO_PI, 0, math.pi]])
    area = 4 * math.pi / n
    cap = 2 * math.asin(math.sqrt(1 / n))
    n_zones = max(1, round((math.pi - 2 * cap) / math.sqrt(area))) if n > 2 else 0
    counts, carry = [], 0.0
    if n_zones:
        height = (math.pi - 2 * cap) / n_zones
        for i in range(n_zones):
            ideal = 2 * math.pi * (math.cos(cap + i * height) - math.cos(cap + (i + 1) * height)) / area
            k = math.floor(ideal + carry + 0.5)
            carry += ideal - k
            counts.append(k)
    rows, before = [[0, TWO_PI, 0, cap]], 1
    colatitude = lambda k: 2 * math.asin(math.sqrt(min(1.0, k / n)))
    offset, last = 0.0, None
    for k in counts:
        if last:
            offset += (1 / k - 1 / last) / 2 + math.gcd(last, k) / (2 * last * k)
            offset -= math.floor(offset)
        lo, hi = colatitude(before), colatitude(before + k)
        rows += [[TWO_PI * (j / k + offset), TWO_PI * ((j + 1) / k + offset), lo, hi] for j in range(k)]
        before, last = before + k, k
    rows.append([0, TWO_PI, colatitude(before), math.pi])
    return np.array(rows)


def patch_of_angles(th: np.ndarray, ph: np.ndarray, patches: np.ndarray) -> np.ndarray:
    """First patch that holds each pair of angles, also a turn later."""
    out = np.full(np.broadcast(th, ph).shape, -1)
    for i in range(len(patches) - 1, -1, -1):
        a, b, c, d = patches[i]
        inside = (ph >= c) & (ph <= d) & (((th >= a) & (th <= b)) | ((th + TWO_PI >= a) & (th + TWO_PI <= b)))
        out[inside] = i
    return out


@lru_cache(maxsize=8)
def patch_table(n: int, n_theta: int, n_phi: int) -> list[int]:
    th = TWO_PI * np.arange(n_theta)[:, None] / n_theta
    ph = math.pi * np.arange(n_phi)[None, :] / n_phi
    return patch_of_angles(th, ph, equal_area_patches(n)).ravel().tolist()


def lookup(table: list[int], th: Column, ph: Column, n_theta: int, n_phi: int) -> Column:
    """Table entry of both angles; the table is one constant of the plan."""
    i, j = table_cell(th, ph, n_theta, n_phi)
    values = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<int>")
    return F.get(values, i * n_phi + j)


def patch_bin(x: Column, y: Column, z: Column, n: int = 360, n_theta: int | None = None, n_phi: int | None = None) -> Column:
    """Equal-area patch of a vector's direction through a table of 2n x n cells (or as given)."""
    nt, npi = n_theta or 2 * n, n_phi or n
    return lookup(patch_table(n, nt, npi), *direction_angles(x, y, z), nt, npi)


def patches(spark: SparkSession, n: int = 360) -> DataFrame:
    """patch_id, theta_lo, theta_hi, phi_lo, phi_hi and the unit vector of the centre."""
    t = equal_area_patches(n)
    th, ph = t[:, :2].mean(1), t[:, 2:].mean(1)
    ph[0], ph[-1] = (0.0, math.pi) if n > 1 else (ph[0], ph[-1])
    rows = np.column_stack([t, np.sin(ph) * np.cos(th), np.sin(ph) * np.sin(th), np.cos(ph)]).tolist()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "patch_id int, theta_lo double, theta_hi double, phi_lo double, phi_hi double, cx double, cy double, cz double")


# ---------------------------------------------------------------- geodesic hierarchy


@lru_cache(maxsize=4)
def geodesic(divisions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles after `divisions` levels: 20 * 4 ** (divisions - 1) triangles; the parent of triangle i is i // 4."""
    g = (1 + math.sqrt(5)) / 2
    v = [(-1, g, 0), (1, g, 0), (-1, -g, 0), (1, -g, 0), (0, -1, g), (0, 1, g), (0, -1, -g), (0, 1, -g), (g, 0, -1), (g, 0, 1), (-g, 0, -1), (-g, 0, 1)]
    v = [np.array(p) / math.sqrt(1 + g * g) for p in v]
    edge = min(np.linalg.norm(v[0] - p) for p in v[1:]) * 1.01
    near = [[np.linalg.norm(p - q) < edge for q in v] for p in v]
    tri = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if near[a][b] and near[b][c] and near[a][c]]
    for _ in range(divisions - 1):
        mid: dict[tuple[int, int], int] = {}

        def middle(a: int, b: int) -> int:
            k = (min(a, b), max(a, b))
            if k not in mid:
                p = v[a] + v[b]
                v.append(p / np.linalg.norm(p))
                mid[k] = len(v) - 1
            return mid[k]

        finer = []
        for a, b, c in tri:
            ab, bc, ca = middle(a, b), middle(b, c), middle(c, a)
            finer += [(a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca)]
        tri = finer
    return np.array(v), np.array(tri)


def triangle_of(points: np.ndarray, divisions: int) -> np.ndarray:
    """First triangle that the ray to each point meets, descending the hierarchy: 20 tests at the root, then 4 a level."""
    v, tri = geodesic(1)
    found = _meets(points[:, None, :], v[tri][None])
    at = found.argmax(1)
    for d in range(2, divisions + 1):
        v, tri = geodesic(d)
        child = at[:, None] * 4 + np.arange(4)
        at = child[np.arange(len(at)), _meets(points[:, None, :], v[tri[child]]).argmax(1)]
    return at


def _meets(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How well p lies in the cone of a triangle, rounded so that edge points count for the first triangle."""
    a, b, c = t[..., 0, :], t[..., 1, :], t[..., 2, :]
    sign = np.sign((np.cross(a, b) * c).sum(-1))
    least = np.minimum.reduce([(np.cross(x, y) * p).sum(-1) * sign for x, y in ((a, b), (b, c), (c, a))])
    return np.minimum(np.round(least, 12), 0)


@lru_cache(maxsize=4)
def geodesic_table(divisions: int, n_theta: int, n_phi: int) -> list[int]:
    th = np.repeat(TWO_PI * np.arange(n_theta) / n_theta, n_phi)
    ph = np.tile(math.pi * np.arange(n_phi) / n_phi, n_theta)
    return triangle_of(np.column_stack([np.sin(ph) * np.cos(th), np.sin(ph) * np.sin(th), np.cos(ph)]), divisions).tolist()


def geodesic_bin(x: Column, y: Column, z: Column, divisions: int = 4, n_theta: int = 720, n_phi: int = 360) -> Column:
    """Geodesic triangle of a vector's direction through a table over both angles."""
    return lookup(geodesic_table(divisions, n_theta, n_phi), *direction_angles(x, y, z), n_theta, n_phi)


def geodesic_exact(df: DataFrame, x: str, y: str, z: str, divisions: int, key: str) -> DataFrame:
    """key, bin by the ray-triangle test: a join with the triangles, whose number is a parameter; the first hit counts. A row that hits none (a zero vector, nulls) has bin null."""
    from ..functions.vector import ray_hits_triangle

    v, tri = geodesic(divisions)
    rows = [(i, *v[t].ravel().tolist()) for i, t in enumerate(tri)]
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    t = df.sparkSession.createDataFrame(rows, "tri int, " + ", ".join(f"{n} double" for n in names))
    d = [F.col(c) for c in (x, y, z)]
    hit = ray_hits_triangle(d, *[[F.col(f"{p}{c}") for c in "xyz"] for p in "abc"])
    return df.join(F.broadcast(t), hit, "left").groupBy(key).agg(F.min("tri").alias("bin"))


def triangles(spark: SparkSession, divisions: int) -> DataFrame:
    """level, tri_id, parent_id, a, b, c of all levels."""
    rows = []
    for d in range(1, divisions + 1):
        rows += [(d, i, i // 4 if d > 1 else None, *map(int, t)) for i, t in enumerate(geodesic(d)[1])]
    return spark.createDataFrame(rows, "level int, tri_id int, parent_id int, a int, b int, c int")
