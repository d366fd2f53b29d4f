"""Vectors as lists of columns, matrices as driver-side numpy arrays applied to them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, s) -> list[Column]:
    return [x * s for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b)])


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def magnitude(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> list[Column]:
    """The zero vector stays."""
    m = magnitude(a)
    return [F.when(m == 0, x).otherwise(x / m) for x in a]


def max_component(a: Vec) -> Column:
    return F.greatest(*a)


def clamp_to_one(a: Vec) -> list[Column]:
    return [F.least(x, F.lit(1.0)) for x in a]


def same(a: Vec, b: Vec, eps: float = 0.0) -> Column:
    return reduce(lambda p, q: p & q, [F.abs(x - y) <= eps for x, y in zip(a, b)])


def less(a: Vec, b: Vec) -> Column:
    return reduce(lambda p, q: p & q, [x < y for x, y in zip(a, b)])


def homogeneous(a: Vec) -> list[Column]:
    """The first three of four coordinates over the fourth."""
    return [x / a[3] for x in a[:3]]


def transform(m: np.ndarray, a: Vec) -> list[Column]:
    """Matrix times column vector."""
    return [reduce(lambda s, t: s + t, [x * float(c) for c, x in zip(row, a)]) for row in np.asarray(m, float)]


def transform_row(a: Vec, m: np.ndarray) -> list[Column]:
    """Row vector times matrix."""
    return transform(np.asarray(m, float).T, a)


def rotation(axis: str, degrees: float) -> np.ndarray:
    """4 x 4 right-handed rotation about x, y or z."""
    k = "xyz".index(axis)
    i, j = (k + 1) % 3, (k + 2) % 3
    m, t = np.eye(4), math.radians(degrees)
    m[i, i] = m[j, j] = math.cos(t)
    m[i, j], m[j, i] = -math.sin(t), math.sin(t)
    return m


def translation(x: float, y: float, z: float) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m


def scaling(x: float, y: float, z: float) -> np.ndarray:
    return np.diag([x, y, z, 1.0])


def inverse(m: np.ndarray) -> np.ndarray:
    """The zero matrix if m is singular."""
    m = np.asarray(m, float)
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.zeros_like(m)


def ray_hits_triangle(d: Vec, p0: Vec, p1: Vec, p2: Vec, eps: float = 1e-9) -> Column:
    """Whether the ray from the origin along d meets the triangle: barycentric coordinates within [0, 1] and a positive distance."""
    e1, e2 = sub(p1, p0), sub(p2, p0)
    h = cross(d, e2)
    a = dot(e1, h)
    s = scale(p0, -1.0)
    u = dot(s, h) / a
    q = cross(s, e1)
    v, t = dot(d, q) / a, dot(e2, q) / a
    return (F.abs(a) > 1e-12) & (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (t > 0)
