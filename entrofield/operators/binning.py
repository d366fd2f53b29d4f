"""Values to histogram bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TWO_PI, clamp, theta

Range = tuple[float, float] | str


def equal_width(v: Column, lo: Column | float, hi: Column | float, n: int | Column) -> Column:
    """clamp(floor((v - lo) / ((hi - lo) / n)), 0, n - 1); a range of zero width puts all in bin 0. Null and undefined values have no bin."""
    lo, hi = [x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi)]
    n = n if isinstance(n, Column) else F.lit(n)
    raw = F.floor((v - lo) / ((hi - lo) / n.cast("double")))
    value = F.when(hi <= lo, F.lit(0)).otherwise(clamp(raw, F.lit(0), n - 1)).cast("int")
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), value)


def default_bins(n: int) -> int:
    """A tenth of the number of values."""
    return max(1, n // 10)


def known(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor undefined."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def with_range(df: DataFrame, value: str, range_: Range = "global", keys: Sequence[str] = ()) -> DataFrame:
    """Adds lo and hi: given, of all rows, or of each group of keys. The range of all rows is one row and is joined by broadcast."""
    if not isinstance(range_, str):
        return df.withColumns({"lo": F.lit(float(range_[0])), "hi": F.lit(float(range_[1]))})
    if range_ == "global":
        r = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
        return df.join(F.broadcast(r))
    if range_ == "block":
        r = df.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
        return df.join(r, list(keys))
    raise ValueError(f"unknown range {range_!r}")


def with_bin(df: DataFrame, n: int, value: str = "value", range_: Range = "global", keys: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """Adds the equal-width bin; rows without a value are dropped."""
    ranged = with_range(known(df, value), value, range_, keys)
    return ranged.withColumn(out, equal_width(F.col(value), F.col("lo"), F.col("hi"), n)).drop("lo", "hi")


def with_joint_bin(df: DataFrame, n: int, first: str, second: str, range1: Range = "global", range2: Range = "global", out: str = "bin") -> DataFrame:
    """Adds bin2 * n + bin1 of two columns of one row."""
    df = with_bin(df, n, first, range1, out="_b1")
    df = with_bin(df, n, second, range2, out="_b2")
    return df.withColumn(out, F.col("_b2") * n + F.col("_b1")).drop("_b1", "_b2")


def joint_fields(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    """Two fields over the same cells, side by side as value1 and value2."""
    return a.withColumnRenamed("value", "value1").join(b.select(key, F.col("value").alias("value2")), key)


def with_component_bins(df: DataFrame, n: int, parts: Sequence[str], ranges: Sequence[Range] | None = None) -> DataFrame:
    """Adds one equal-width bin per component: bin_<name>."""
    for name, r in zip(parts, ranges or ["global"] * len(parts)):
        df = with_bin(df, n, name, r, out=f"bin_{name}")
    return df


def angle_bin(x: Column, y: Column, n: int) -> Column:
    """Equal sectors of the plane."""
    return clamp(F.floor(theta(x, y) / TWO_PI * n), F.lit(0), F.lit(n - 1)).cast("int")


def table_cell(th: Column, ph: Column, n_theta: int, n_phi: int) -> tuple[Column, Column]:
    """Cell of a lookup table over both angles."""
    i = clamp(F.floor(n_theta * th / TWO_PI), F.lit(0), F.lit(n_theta - 1)).cast("int")
    j = clamp(F.floor(n_phi * ph / math.pi), F.lit(0), F.lit(n_phi - 1)).cast("int")
    return i, j
