"""Entropy of kernel densities, exact and in cells, against all pairs in numpy."""

import numpy as np
import pytest

from entrofield.operators import density
from entrofield.plans import registry


def brute(v, h):
    d = np.concatenate([np.exp(-(((v[i : i + 500, None] - v) / h) ** 2) / 2).sum(1) for i in range(0, len(v), 500)])
    p = d / d.sum()
    return -(p * np.log2(p)).sum()


def test_continuous_column(spark, sf):
    v = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice").toPandas().l_extendedprice.to_numpy()
    assert len(np.unique(v)) > 4096
    got = registry.QUERIES["e5_kde_entropy_binned"](spark, sf).first().entropy
    assert got == pytest.approx(brute(v, 1.06 * v.std() * len(v) ** -0.2), abs=1e-4)


def test_far_outliers_keep_the_bulk_apart(spark):
    v = np.concatenate([np.random.default_rng(3).normal(size=5000), [1e7, -1e7]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert density.kde_entropy_binned(df, "v", 0.1).first().entropy == pytest.approx(brute(v, 0.1), abs=1e-4)


def test_exact_at_any_size(spark):
    """More distinct values than any table of cells; equal values count as often as they occur."""
    v = np.concatenate([np.random.default_rng(3).normal(size=6000), np.zeros(500), [1e7, -1e7]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert density.kde_entropy(df, "v", 0.1).first().entropy == pytest.approx(brute(v, 0.1), abs=1e-9)
