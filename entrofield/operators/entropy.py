"""Histograms and Shannon entropies (base 2) of binned rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, keys: Sequence[str] = (), bin_: str = "bin") -> DataFrame:
    """keys, bin, n. Partial counts are made before the shuffle."""
    return df.groupBy(*keys, bin_).agg(F.count("*").alias("n"))


def merge_counts(parts: Sequence[DataFrame], keys: Sequence[str] = (), bin_: str = "bin") -> DataFrame:
    """Sum of several histograms."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, bin_).agg(F.sum("n").alias("n"))


def normalized(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds p = n over the group's total."""
    total = hist.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else hist.agg(F.sum("n").alias("total"))
    joined = hist.join(total, list(keys)) if keys else hist.join(F.broadcast(total))
    return joined.withColumn("p", F.col("n") / F.col("total")).drop("total")


def dense(hist: DataFrame, n_bins: int, bin_: str = "bin") -> DataFrame:
    """bin, n for every bin, 0 where none counts."""
    all_bins = hist.sparkSession.range(n_bins).select(F.col("id").cast("int").alias(bin_))
    return all_bins.join(hist, bin_, "left").select(bin_, F.coalesce("n", F.lit(0)).alias("n"))


def entropy_of(n: str | Column = "n", n_bins: int | None = None) -> Column:
    """Aggregate over a group's counts or weights: log2 N - sum(n log2 n) / N, one pass without a window; over log2(n_bins) if given (0 for one bin)."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.sum(n)
    h = F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)) / total
    h = F.when(h < 0, F.lit(0.0)).otherwise(h)  # rounding; no rows give null
    if n_bins is None:
        return h
    return h / math.log2(n_bins) if n_bins > 1 else F.lit(0.0) * total


def from_counts(hist: DataFrame, keys: Sequence[str] = (), n_bins: int | None = None, n: str = "n") -> DataFrame:
    """keys, entropy."""
    value = entropy_of(n, n_bins).alias("entropy")
    return hist.groupBy(*keys).agg(value) if keys else hist.agg(value)


def from_probabilities(df: DataFrame, p: str = "p", keys: Sequence[str] = (), n_bins: int | None = None) -> DataFrame:
    """Entropy of given probabilities, which are not normalised again."""
    h = -F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p)).otherwise(0.0))
    h = h if n_bins is None else h / math.log2(n_bins) if n_bins > 1 else h * 0
    return df.groupBy(*keys).agg(h.alias("entropy")) if keys else df.agg(h.alias("entropy"))


def of_bins(df: DataFrame, keys: Sequence[str] = (), n_bins: int | None = None, bin_: str = "bin") -> DataFrame:
    """Entropy of a bin column, globally or per group: two aggregations."""
    return from_counts(counts(df, keys, bin_), keys, n_bins)


def of_bin_array(bins: Column) -> Column:
    """Entropy of an array of bin ids within a row."""
    kinds = F.array_distinct(bins)
    n = F.transform(kinds, lambda k: F.size(F.filter(bins, lambda b: b == k)).cast("double"))
    total = F.size(bins).cast("double")
    return F.aggregate(n, F.lit(0.0), lambda s, k: s - k / total * F.log2(k / total))


def statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population variance and standard deviation."""
    aggs = [F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("std")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def histogram_statistics(hist: DataFrame, centre: Column, n: str = "n") -> DataFrame:
    """Mean and variance of a histogram's bin centres weighted by counts."""
    w, c = F.col(n).cast("double"), centre
    mean, square = F.sum(w * c) / F.sum(w), F.sum(w * c * c) / F.sum(w)
    return hist.agg(mean.alias("mean"), (square - mean * mean).alias("variance"))


def array_statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    aggs = [F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
