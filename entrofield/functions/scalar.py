"""Element-wise functions: ranges, boundaries, arrays, interpolation, angles, feature mappings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def clamp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    lo, hi = [x if isinstance(x, Column) else F.lit(x) for x in (lo, hi)]
    return F.least(F.greatest(v, lo), hi)


def boundary(v: Column, n: int | Column, mode: str = "mirror") -> Column:
    """Index v of an axis of length n brought into 0..n-1.

    mirror: -1 -> 0, but n -> n - 3 (the high side skips two cells); reflect: the same on both sides, n -> n - 1; clamp: the nearest index.
    """
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    if mode == "clamp":
        return clamp(v, F.lit(0), last)
    high = {"mirror": 2 * last - v - 1, "reflect": 2 * last - v + 1}
    if mode not in high:
        raise ValueError(f"unknown boundary {mode!r}")
    return F.when(v < 0, -v - 1).when(v > last, high[mode]).otherwise(v)


def finite(v: Column, other: float = 0.0) -> Column:
    """Infinite and undefined values replaced."""
    bad = F.isnan(v) | (v == float("inf")) | (v == float("-inf"))
    return F.when(bad, F.lit(other)).otherwise(v)


# ---- arrays


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def array_fill(a: Column, v: float) -> Column:
    return F.transform(a, lambda _: F.lit(v))


def array_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def array_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def array_add_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x + s)


def array_scale(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * s)


def array_divide(a: Column, s: float) -> Column:
    """Division by zero leaves the array as it is."""
    return F.transform(a, lambda x: x / s) if s else a


def array_mean_with(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


# ---- interpolation; the first value has weight f


def lerp(a: Column, b: Column, f: Column | float) -> Column:
    f = f if isinstance(f, Column) else F.lit(f)
    return a * f + b * (1 - f)


def bilerp(v: Sequence[Column], fx: Column | float, fy: Column | float) -> Column:
    return lerp(lerp(v[0], v[1], fx), lerp(v[2], v[3], fx), fy)


def trilerp(v: Sequence[Column], fx: Column | float, fy: Column | float, fz: Column | float) -> Column:
    return lerp(bilerp(v[:4], fx, fy), bilerp(v[4:], fx, fy), fz)


def vector_lerp(a: Column, b: Column, f: Column | float) -> Column:
    return F.zip_with(a, b, lambda x, y: lerp(x, y, f))


def vector_bilerp(v: Sequence[Column], fx: float, fy: float) -> Column:
    return vector_lerp(vector_lerp(v[0], v[1], fx), vector_lerp(v[2], v[3], fx), fy)


def vector_trilerp(v: Sequence[Column], fx: float, fy: float, fz: float) -> Column:
    return vector_lerp(vector_bilerp(v[:4], fx, fy), vector_bilerp(v[4:], fx, fy), fz)


def nearest_corner(v: Sequence[Column], f: Sequence[Column]) -> Column:
    """Value of the corner of the unit cell (x fastest) nearest to the point f; ties go to the first corner."""
    struct = []
    for i, c in enumerate(v):
        d = sum(((f[k] - ((i >> k) & 1)) * (f[k] - ((i >> k) & 1)) for k in range(3)), F.lit(0.0))
        struct.append(F.struct(d.alias("d"), F.lit(i).alias("i"), c.alias("v")))
    return F.array_min(F.array(*struct))["v"]


# ---- angles


def theta(x: Column, y: Column) -> Column:
    """pi + atan2(y, x), from 0 to 2 pi; 0 for the zero vector."""
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.lit(math.pi) + F.atan2(y, x))


def phi(rho: Column, z: Column) -> Column:
    """|pi/2 - atan2(z, rho)|, from 0 to pi; 0 for the zero vector."""
    return F.when((rho == 0) & (z == 0), F.lit(0.0)).otherwise(F.abs(F.lit(math.pi / 2) - F.atan2(z, rho)))


def direction_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return theta(x, y), phi(F.sqrt(x * x + y * y), z)


def unit_vector(th: Column, ph: Column) -> tuple[Column, Column, Column]:
    """Point of the unit sphere at (theta, phi)."""
    return F.sin(ph) * F.cos(th), F.sin(ph) * F.sin(th), F.cos(ph)


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Radius, theta, phi."""
    return (F.sqrt(x * x + y * y + z * z), *direction_angles(x, y, z))


def cartesian(r: Column, th: Column, ph: Column) -> tuple[Column, Column, Column]:
    return tuple(r * c for c in unit_vector(th, ph))


def log_base(v: Column, base: float) -> Column:
    return F.log(v) / math.log(base)


# ---- feature mappings of random variables


def norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum((c * c for c in parts), F.lit(0.0)))


MAPPINGS = ("raw", "abs", "dir", "log")


def mapping_name(text: str) -> str:
    """Mapping of a three-letter name; abs if it is none."""
    return text if text in MAPPINGS else "abs"


def feature(parts: Sequence[Column], mapping: str, patch=None) -> Column:
    """raw: the only component; abs: Euclidean norm; log: log10 of the norm; dir: angle of two components or sphere patch of three (through `patch`)."""
    mapping = mapping_name(mapping)
    if mapping == "raw":
        if len(parts) != 1:
            raise ValueError("raw needs one component")
        return parts[0]
    if mapping == "abs":
        return norm(parts)
    if mapping == "log":
        return F.log10(norm(parts))
    if len(parts) == 2:
        return F.atan2(parts[1], parts[0])
    if len(parts) == 3 and patch is not None:
        return patch(*parts).cast("double")
    raise ValueError("dir needs two components, or three and a patch function")


def default_range(mapping: str, n_parts: int, n_patches: int = 360) -> tuple[float, float]:
    mapping = mapping_name(mapping)
    if mapping == "dir":
        return (-math.pi, math.pi) if n_parts == 2 else (0.0, float(n_patches))
    return (0.0, math.inf) if mapping == "abs" else (-math.inf, math.inf)


def bin_coordinate(v: Column, own: tuple[float, float], given: tuple[float, float], n_bins: int) -> Column:
    """Real-valued bin of a sample over the intersection of both ranges, from 0 to n_bins."""
    lo, hi = max(own[0], given[0]), min(own[1], given[1])
    if not (math.isfinite(lo) and math.isfinite(hi)) or hi <= lo:
        raise ValueError("the ranges have no finite intersection")
    return clamp((v - lo) / (hi - lo) * n_bins, 0.0, float(n_bins))
