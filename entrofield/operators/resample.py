"""Scattered points onto a regular grid by inverse squared distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import GridSpec


def resample(points: DataFrame, grid: GridSpec, origin: Sequence[float], spacing: Sequence[float], radius: float = 1.0, value: str = "value") -> DataFrame:
    """cell_id, x, y, z, value of the grid points with a sample within `radius` spacings along every axis. A sample on a grid point counts with a large finite weight.

    Each point goes to the few grid points around it; sums are aggregated before the shuffle.
    """
    df = points
    for c, o, h, n in zip("xyz", origin, spacing, grid.dims):
        at = (F.col(c) - o) / h
        first, last = F.greatest(F.ceil(at - radius), F.lit(0)).cast("int"), F.least(F.floor(at + radius), F.lit(n - 1)).cast("int")
        df = df.withColumn(f"g{c}", F.explode(F.when(first <= last, F.sequence(first, last))))
    d2 = sum(((F.col(c) - o - F.col(f"g{c}") * h) * (F.col(c) - o - F.col(f"g{c}") * h) for c, o, h in zip("xyz", origin, spacing)), F.lit(0.0))
    w = 1 / F.greatest(d2, F.lit(1e-12))
    out = df.groupBy("gx", "gy", "gz").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"))
    out = out.select(*[(F.col(f"g{c}") + l).cast("int").alias(c) for c, l in zip("xyz", grid.low)], "value")
    return out.select(grid.cell_id(F.col("x"), F.col("y"), F.col("z")).alias("cell_id"), "x", "y", "z", "value")
