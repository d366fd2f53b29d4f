"""Kernel densities and cross-validated bin counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import Range, equal_width, known, with_bin, with_range
from .entropy import counts


#: Cells a bandwidth, and bandwidths from which exp(-d * d / 2) underflows to 0.
FINE, REACH = 64, 40
#: Tasks that share the points of a block.
PARTS = 32


def gaussian(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    sigma = sigma if isinstance(sigma, Column) else F.lit(sigma)
    d = (x - mu) / sigma
    return F.exp(-d * d / 2) / (sigma * math.sqrt(2 * math.pi))


def bandwidth(kind: str, n: Column, var: Column) -> Column:
    """1.06 * v * n ** -0.2, where v is the variance (`variance`, as published) or the standard deviation (`silverman`)."""
    return 1.06 * (var if kind == "variance" else F.sqrt(var)) * F.pow(n.cast("double"), F.lit(-0.2))


def kde(df: DataFrame, value: str, m: int, h: float | str = "variance") -> DataFrame:
    """i, x, density at m evenly spaced points from the least to the largest value.

    Each row adds to m sums that are aggregated before the shuffle: the points are a parameter, so what each task keeps is bounded.
    """
    df = known(df, value).select(F.col(value).cast("double").alias("v"))
    stats = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.var_pop("v").alias("var"))
    width = F.lit(float(h)) if not isinstance(h, str) else bandwidth(h, F.col("n"), F.col("var"))
    stats = stats.withColumn("h", width)
    points = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(max(1, m - 1))).alias("x")))
    each = df.join(F.broadcast(stats)).withColumn("p", F.explode(points))
    out = each.groupBy("p.i").agg(F.first("p.x").alias("x"), (F.sum(gaussian(F.col("p.x"), F.col("v"), F.col("h"))) / F.first("n")).alias("density"))
    return out.select("i", "x", "density")


def kde_entropy(df: DataFrame, value: str, h: float | str = "variance", normalize: bool = False) -> DataFrame:
    """-sum p log2 p over the rows' own kernel densities p, each normalised by the sum of densities.

    Exact: distinct values, weighted by their counts, meet all others of their own and the neighbouring blocks of REACH * h; beyond, a kernel is 0 in double. So the cost grows with the
    square of the distinct values within that reach; kde_entropy_binned() is the approximation for many.
    """
    return _kde_entropy(df, value, h, normalize, F.col("v"))


def kde_entropy_binned(df: DataFrame, value: str, h: float | str = "variance", normalize: bool = False) -> DataFrame:
    """kde_entropy() of values counted in cells of h / FINE, whatever the range, where each cell stands at its mean: exact up to the width of a cell, at a cost that depends on the range in
    bandwidths alone.
    """
    return _kde_entropy(df, value, h, normalize, F.floor((F.col("v") - F.col("lo")) / (F.col("h") / FINE)).cast("double"))


def _kde_entropy(df: DataFrame, value: str, h: float | str, normalize: bool, cell: Column) -> DataFrame:
    df = known(df, value).select(F.col(value).cast("double").alias("v"))
    stats = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.var_pop("v").alias("var"))
    width = F.lit(float(h)) if not isinstance(h, str) else bandwidth(h, F.col("n"), F.col("var"))
    stats = stats.withColumn("h", width)
    points = df.join(F.broadcast(stats)).groupBy(cell.alias("cell")).agg(F.avg("v").alias("v"), F.count("*").alias("w"), F.first("h").alias("h"), F.first("n").alias("n"), F.first("lo").alias("lo"))
    points = points.withColumn("block", F.floor((F.col("v") - F.col("lo")) / (F.col("h") * REACH)))
    # one block can hold all values: its points are dealt over PARTS tasks, to each of which the others go
    points = points.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(PARTS)))
    other = points.select(F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)])).alias("block"), F.col("v").alias("v2"), F.col("w").alias("w2"))
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    dens = points.join(other, ["block", "part"]).groupBy("cell", "w", "n").agg((F.sum(F.col("w2") * gaussian(F.col("v"), F.col("v2"), F.col("h"))) / F.first("n")).alias("d"))
    total = dens.agg(F.sum(F.col("w") * F.col("d")).alias("t"))
    p = F.col("d") / F.col("t")
    out = -F.sum(F.col("w") * p * F.log2(p))
    return dens.join(F.broadcast(total)).agg((out / F.log2(F.first("n").cast("double")) if normalize else out).alias("entropy"))


# ---------------------------------------------------------------- cross-validation


def cv_score(sum_p2: Column, n: Column, h: Column) -> Column:
    """(2 - (N + 1) sum p^2) / ((N - 1) h); lower is better."""
    return (2 - (n + 1) * sum_p2) / ((n - 1) * h)


def scores(hist: DataFrame, width: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n_bins, score from counts n of each (keys, n_bins, bin); width may use columns lo, hi, n_bins."""
    n = F.sum("n")
    p2 = F.sum(F.col("n").cast("double") * F.col("n")) / (n.cast("double") * n)
    return hist.groupBy(*keys, "n_bins").agg(cv_score(p2, n.cast("double"), F.first(width)).alias("score"))


def best(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of bins with the least score (the least number among equals)."""
    pick = F.min(F.struct("score", "n_bins"))
    out = scored.groupBy(*keys).agg(pick.alias("b")) if keys else scored.agg(pick.alias("b"))
    return out.select(*keys, F.col("b.n_bins").alias("n_bins"), F.col("b.score").alias("score"))


def linear_sweep(df: DataFrame, value: str, start: int, step: int, n: int, range_: Range = "global", keys: Sequence[str] = ()) -> DataFrame:
    """Score of start, start + step, ... bins, each binned from the data in one scan; counts are aggregated before the shuffle."""
    ranged = with_range(known(df, value), value, range_, keys)
    each = ranged.withColumn("n_bins", F.explode(F.array(*[F.lit(start + i * step) for i in range(n)])))
    hist = each.groupBy(*keys, "n_bins", "lo", "hi", equal_width(F.col(value), F.col("lo"), F.col("hi"), F.col("n_bins")).alias("bin")).agg(F.count("*").alias("n"))
    return scores(hist, (F.col("hi") - F.col("lo")) / F.col("n_bins"), keys)


def halving_sweep(df: DataFrame, value: str, n_max: int, levels: int, range_: Range = "global", keys: Sequence[str] = ()) -> DataFrame:
    """Score of n_max, n_max / 2, ... bins from one pass over the data: neighbouring bins of the finest histogram are merged."""
    ranged = with_range(known(df, value), value, range_, keys)
    finest = ranged.groupBy(*keys, "lo", "hi", equal_width(F.col(value), F.col("lo"), F.col("hi"), n_max).alias("bin")).agg(F.count("*").alias("n"))
    return scores(_merged(finest, n_max, levels, 1, [*keys, "lo", "hi"]), (F.col("hi") - F.col("lo")) / F.col("n_bins"), keys)


def _merged(finest: DataFrame, n_max: int, levels: int, bits: int, keys: Sequence[str]) -> DataFrame:
    """Counts at each level: level k merges 2 ** (k * bits) neighbours. Only histogram rows are multiplied."""
    each = finest.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    merged = F.floor(F.col("bin") / F.pow(F.lit(2.0), F.col("k") * bits)).cast("int")
    return each.groupBy(*keys, F.floor(F.lit(n_max) / F.pow(F.lit(2.0), F.col("k") * bits)).cast("int").alias("n_bins"), merged.alias("bin")).agg(F.sum("n").alias("n"))


def geodesic_sweep(df: DataFrame, bin_: str, divisions: int, levels: int | None = None, keys: Sequence[str] = (), width: str = "area") -> DataFrame:
    """Scores of a geodesic hierarchy, merging four children into a parent. Bin width: sqrt(4 pi / n) (`area`), or that of the finest level times four a level (`published`)."""
    levels = levels or divisions
    n_max = 20 * 4 ** (divisions - 1)
    hist = _merged(counts(df, keys, bin_).withColumnRenamed(bin_, "bin"), n_max, levels, 2, keys)
    n = F.col("n_bins").cast("double")
    h = F.sqrt(4 * math.pi / n) if width == "area" else math.sqrt(4 * math.pi / n_max) * 4 * n_max / n
    return scores(hist, h, keys)


def binned_at_best(df: DataFrame, value: str, n_max: int, levels: int) -> DataFrame:
    """Rows with the bin of the best halving count (one small result on the driver)."""
    n = best(halving_sweep(df, value, n_max, levels)).first()["n_bins"]
    return with_bin(df, n, value)
