"""Regular grids: metadata on the driver, cells as rows (cell_id, x, y, z, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp


@dataclass(frozen=True)
class GridSpec:
    """Size of a grid and the index of its lowest cell; x varies fastest."""

    dims: tuple[int, int, int]
    low: tuple[int, int, int] = (0, 0, 0)

    @classmethod
    def from_bounds(cls, low: Sequence[float], high: Sequence[float]) -> GridSpec:
        lo, hi = [math.floor(v) for v in low], [math.ceil(v) for v in high]
        return cls(tuple(h - l + 1 for l, h in zip(lo, hi)), tuple(lo))

    @property
    def size(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    @property
    def high(self) -> tuple[int, int, int]:
        return tuple(l + d - 1 for l, d in zip(self.low, self.dims))

    def cell_id(self, x: Column, y: Column, z: Column) -> Column:
        lx, ly, lz = self.low
        nx, ny, _ = self.dims
        return ((z - lz).cast("long") * ny + (y - ly)) * nx + (x - lx)

    def coordinates(self, cell: Column) -> tuple[Column, Column, Column]:
        nx, ny, _ = self.dims
        return ((cell % nx) + self.low[0]).cast("int"), (F.floor(cell / nx) % ny + self.low[1]).cast("int"), (F.floor(cell / (nx * ny)) + self.low[2]).cast("int")

    def clamped_id(self, x: Column, y: Column, z: Column) -> Column:
        return self.cell_id(*[clamp(c, F.lit(l), F.lit(h)) for c, l, h in zip((x, y, z), self.low, self.high)])


@dataclass(frozen=True)
class Field:
    """A DataFrame of cells with its grid."""

    df: DataFrame
    grid: GridSpec

    @classmethod
    def from_ids(cls, df: DataFrame, grid: GridSpec, cell: str = "cell_id", value: str = "value") -> Field:
        x, y, z = grid.coordinates(F.col(cell))
        return cls(df.select(F.col(cell).alias("cell_id"), x.alias("x"), y.alias("y"), z.alias("z"), F.col(value).alias("value")), grid)

    def between(self, low: Sequence[float], high: Sequence[float]) -> Field:
        """Cells of a closed box; fractional bounds grow outwards."""
        g = GridSpec.from_bounds(low, high)
        cond = F.lit(True)
        for name, l, h in zip("xyz", g.low, g.high):
            cond &= F.col(name).between(l, h)
        return Field(self.df.where(cond), g)

    sub_field = between

    def at(self, cell: int) -> DataFrame:
        return self.df.where(F.col("cell_id") == cell)

    def at_point(self, x: int, y: int, z: int) -> DataFrame:
        return self.df.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z))

    def with_value(self, cell: int, value: float) -> Field:
        return Field(self.df.withColumn("value", F.when(F.col("cell_id") == cell, F.lit(value)).otherwise(F.col("value"))), self.grid)
