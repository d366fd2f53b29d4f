"""Random fields of a simulation: blocks, data components, random variables, time steps.

A session holds DataFrames lazily; nothing runs before a result is used. Blocks are rows with (time_step, block_id) and component columns, so all blocks and steps are evaluated at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_coordinate, clamp, default_range, feature, mapping_name
from .blocks import with_global_ids
from .entropy import of_bins
from .grid import GridSpec
from .sphere import patch_bin
from .stencil import local_entropy

GLOBAL_STEP = -1
KEYS = ("time_step", "block_id")


def file_name(name: str) -> str:
    """A caller's name without blanks and characters that file systems refuse."""
    return re.sub(r"[^\w.-]+", "_", name.strip()).strip("_")


@dataclass(frozen=True)
class Component:
    """A named input column with the range its values are clamped to."""

    name: str
    column: str
    lo: float = -math.inf
    hi: float = math.inf

    def expr(self) -> Column:
        c = F.col(self.column).cast("double")
        return clamp(c, self.lo, self.hi) if math.isfinite(self.lo) or math.isfinite(self.hi) else c


@dataclass(frozen=True)
class RandomVariable:
    """A value derived from components, with its range and number of bins."""

    name: str
    components: tuple[str, ...]
    mapping: str = "abs"
    lo: float = -math.inf
    hi: float = math.inf
    n_bins: int = 360

    def range(self) -> tuple[float, float]:
        own = default_range(self.mapping, len(self.components))
        return max(self.lo, own[0]), min(self.hi, own[1])


@dataclass
class RandomField:
    """df: time_step, block_id, x, y, z and component columns."""

    df: DataFrame
    components: dict[str, Component] = field(default_factory=dict)
    variables: dict[str, RandomVariable] = field(default_factory=dict)
    coords: dict[int, DataFrame] = field(default_factory=dict)

    # ---- description

    def component(self, name: str, column: str | None = None, lo: float = -math.inf, hi: float = math.inf) -> RandomField:
        self.components[name] = Component(name, column or name, lo, hi)
        return self

    def random_variable(self, name: str, components: Sequence[str], mapping: str = "abs", lo: float = -math.inf, hi: float = math.inf, n_bins: int = 360) -> RandomField:
        self.variables[name] = RandomVariable(name, tuple(components), mapping_name(mapping), lo, hi, n_bins)
        return self

    def as_scalar(self, name: str, component: str, **kw) -> RandomField:
        return self.random_variable(name, [component], "raw", **kw)

    def as_vector2(self, name: str, components: Sequence[str], **kw) -> RandomField:
        return self.random_variable(name, components, "dir", **kw)

    as_vector3 = as_vector2

    def rectangular_coordinates(self, dim: int, df: DataFrame) -> RandomField:
        """df: time_step, block_id, i, coord along one dimension."""
        self.coords[dim] = df
        return self

    def global_blocks(self, mapping: DataFrame, one_based: bool = False) -> RandomField:
        self.df = with_global_ids(self.df, mapping, one_based)
        return self

    def at_step(self, step: int) -> RandomField:
        return replace(self, df=self.df.where(F.col("time_step") == step))

    def use_domain_range(self, name: str) -> RandomField:
        """Range of a variable over all blocks and steps: one small aggregate on the driver."""
        v = self.variables[name]
        lo, hi = self.df.select(self.value(v).alias("v")).where("v is not null and not isnan(v)").agg(F.min("v"), F.max("v")).first()
        self.variables[name] = replace(v, lo=lo, hi=hi)
        return self

    # ---- samples

    def value(self, v: RandomVariable) -> Column:
        parts = [self.components[c].expr() for c in v.components]
        return feature(parts, v.mapping, patch_bin)

    def samples(self, name: str) -> DataFrame:
        """Rows with the variable's clamped `value` and its real-valued `coordinate` from 0 to n_bins; rows without a value are left out."""
        v = self.variables[name]
        out = self.df.withColumn("value", self.value(v)).where("value is not null and not isnan(value)")
        own = v.range()
        return out.withColumns({"value": clamp(F.col("value"), *own), "coordinate": bin_coordinate(F.col("value"), default_range(v.mapping, len(v.components)), own, v.n_bins)})

    def bins(self, name: str, out: str = "bin") -> DataFrame:
        v, value = self.variables[name], self.value(self.variables[name])
        own = v.range()
        at = bin_coordinate(clamp(value, *own), default_range(v.mapping, len(v.components)), own, v.n_bins)
        known = self.df.where(value.isNotNull() & ~F.isnan(value))
        return known.withColumn(out, F.least(F.floor(at), F.lit(v.n_bins - 1)).cast("int"))

    # ---- results

    def entropy(self, name: str) -> DataFrame:
        """time_step, block_id, rv, entropy of every block."""
        return of_bins(self.bins(name), list(KEYS)).withColumn("rv", F.lit(name)).select(*KEYS, "rv", "entropy")

    def joint_entropy(self, first: str, second: str) -> DataFrame:
        n = self.variables[first].n_bins
        both = replace(self, df=self.bins(first, "_b1")).bins(second, "_b2")
        return of_bins(both.withColumn("bin", F.col("_b2").cast("long") * n + F.col("_b1")), list(KEYS)).withColumn("rv", F.lit(f"{first},{second}")).select(*KEYS, "rv", "entropy")

    def local_entropy(self, name: str, grid: GridSpec, radius: int, step: int, block_id: int, mode: str = "clamp") -> DataFrame:
        """Entropy field of one block of one step."""
        v = self.variables[name]
        one = self.bins(name).where((F.col("time_step") == step) & (F.col("block_id") == block_id))
        return local_entropy(one, grid, radius, v.n_bins, mode=mode)

    def geometry(self) -> DataFrame:
        """time_step, block_id, dim, i, coord, delta to the next coordinate."""
        out = None
        for dim, df in self.coords.items():
            one = df.select(*KEYS, F.lit(dim).alias("dim"), "i", "coord")
            out = one if out is None else out.unionByName(one)
        w = Window.partitionBy(*KEYS, "dim").orderBy("i")
        return out.withColumn("delta", F.lead("coord").over(w) - F.col("coord"))

    def feature_vectors(self, name: str) -> DataFrame:
        """The variable's components as an array of 1 or 3 numbers (a missing third is 0)."""
        v = self.variables[name]
        parts = [self.components[c].expr() for c in v.components]
        parts = parts + [F.lit(0.0)] * (3 - len(parts)) if len(parts) > 1 else parts
        return self.df.select(*KEYS, "x", "y", "z", F.array(*parts).alias("value"))


class Session:
    """A named run whose results go to tables below path/name, appended per time step: geom, data, rv, entropy."""

    def __init__(self, name: str, path: str):
        self.name, self.path = file_name(name), f"{path.rstrip('/')}/{file_name(name)}"
        self.fields: list[RandomField] = []

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.fields.clear()

    def add(self, df: DataFrame) -> RandomField:
        self.fields.append(RandomField(df))
        return self.fields[-1]

    def _append(self, df: DataFrame, kind: str) -> None:
        # a step written again replaces its partition, so a repeated job leaves each step once
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time_step").parquet(f"{self.path}/{kind}")

    def write_geometry(self, f: RandomField) -> None:
        self._append(f.geometry(), "geom")

    def write_data(self, f: RandomField) -> None:
        cols = [F.col(c.column).cast("double").alias(f"data_{file_name(c.name)}") for c in f.components.values()]
        self._append(f.df.select("time_step", "block_id", "x", "y", "z", *cols), "data")

    def write_samples(self, f: RandomField) -> None:
        cols = [f.value(v).cast("float").alias(f"rv_{file_name(v.name)}") for v in f.variables.values()]
        self._append(f.df.select("time_step", "block_id", "x", "y", "z", *cols), "rv")

    def write_entropy(self, f: RandomField, name: str) -> None:
        self._append(f.entropy(name), "entropy")

    def read(self, spark, kind: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{kind}")
