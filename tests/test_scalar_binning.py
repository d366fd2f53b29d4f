import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entrofield.functions import scalar as S
from entrofield.functions import vector as V
from entrofield.operators import binning as B
from entrofield.operators import entropy as E
from entrofield.operators import sphere
from entrofield.operators.grid import Field, GridSpec


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_boundaries(spark):
    i = spark.createDataFrame([(k,) for k in range(-3, 13)], "i int")
    got = {r.i: (r.m, r.r, r.c) for r in i.select("i", *[S.boundary(F.col("i"), 10, m).alias(m[0]) for m in ("mirror", "reflect", "clamp")]).collect()}
    assert got[-1] == (0, 0, 0) and got[-3] == (2, 2, 0) and got[9] == (9, 9, 9)
    assert got[10] == (7, 9, 9) and got[12] == (5, 7, 9)
    with pytest.raises(ValueError):
        S.boundary(F.lit(1), 3, "wrap")


def test_interpolation_corners(spark):
    v = [F.lit(float(i)) for i in range(8)]
    assert value(spark, S.trilerp(v, 1.0, 1.0, 1.0)) == 0 and value(spark, S.trilerp(v, 0.0, 0.0, 0.0)) == 7
    assert value(spark, S.nearest_corner(v, [F.lit(0.9), F.lit(0.1), F.lit(0.8)])) == 5


def test_angles_of_axes(spark):
    zero = [F.lit(0.0)] * 3
    assert [value(spark, e) for e in S.direction_angles(*zero)] == [0, 0]
    assert value(spark, S.theta(F.lit(1.0), F.lit(0.0))) == pytest.approx(math.pi)
    assert value(spark, S.phi(F.lit(0.0), F.lit(-2.0))) == pytest.approx(math.pi)


def test_features():
    with pytest.raises(ValueError):
        S.feature([F.lit(1), F.lit(2)], "raw")
    assert S.mapping_name("xyz") == "abs" and S.default_range("dir", 3) == (0.0, 360.0)
    with pytest.raises(ValueError):
        S.bin_coordinate(F.lit(1.0), (0.0, math.inf), (0.0, math.inf), 5)


def test_matrices():
    m = V.translation(1, 2, 3) @ V.rotation("x", 90) @ V.scaling(2, 3, 4)
    assert np.allclose(V.inverse(m) @ m, np.eye(4)) and not V.inverse(np.zeros((4, 4))).any()


def test_bins_of_edges_nulls_and_constants(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.999,), (10.0,), (None,), (float("nan"),)], "value double")
    assert [r.bin for r in B.with_bin(df, 10).orderBy("value").collect()] == [0, 1, 9, 9]
    flat = spark.createDataFrame([(3.0,)] * 4, "value double")
    assert E.of_bins(B.with_bin(flat, 10), n_bins=10).first().entropy == 0
    assert E.of_bins(B.with_bin(df.limit(0), 10)).first().entropy is None


@pytest.mark.parametrize("k", [1, 2, 8, 100])
def test_uniform_entropy(spark, k):
    df = spark.range(k * 20).select((F.col("id") % k).cast("double").alias("value"))
    assert E.of_bins(B.with_bin(df, k)).first().entropy == pytest.approx(math.log2(k), abs=1e-9)
    assert E.of_bins(B.with_bin(df, k), n_bins=k).first().entropy == pytest.approx(1.0 if k > 1 else 0.0, abs=1e-9)


def test_joint_entropy_of_independent_and_equal_fields(spark):
    df = spark.range(3200).select((F.col("id") % 8).cast("double").alias("a"), (F.floor(F.col("id") / 8) % 4).cast("double").alias("b"), (F.col("id") % 8).cast("double").alias("c"))
    assert E.of_bins(B.with_joint_bin(df, 8, "a", "b")).first().entropy == pytest.approx(5.0)
    assert E.of_bins(B.with_joint_bin(df, 8, "a", "c")).first().entropy == pytest.approx(3.0)


def test_partition_count_does_not_matter(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_extendedprice").alias("value"))
    h = [E.of_bins(B.with_bin(df.repartition(n), 50)).first().entropy for n in (1, 3, 9)]
    assert max(h) - min(h) < 1e-12


@pytest.mark.parametrize("n", [2, 7, 90, 360, 1000])
def test_equal_area_patches(n):
    t = sphere.equal_area_patches(n)
    area = (t[:, 1] - t[:, 0]) * (np.cos(t[:, 2]) - np.cos(t[:, 3]))
    assert len(t) == n and np.allclose(area, 4 * math.pi / n)


def fibonacci(n):
    i = np.arange(n) + 0.5
    z, a = 1 - 2 * i / n, math.pi * (1 + 5**0.5) * i
    return np.column_stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z])


def test_patch_bins_against_brute_force(spark):
    p = fibonacci(3000)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "vec_id long, x double, y double, z double")
    got = np.array([r.b for r in df.select("vec_id", sphere.patch_bin(F.col("x"), F.col("y"), F.col("z"), 60).alias("b")).orderBy("vec_id").collect()])
    th, ph = math.pi + np.arctan2(p[:, 1], p[:, 0]), np.abs(math.pi / 2 - np.arctan2(p[:, 2], np.hypot(p[:, 0], p[:, 1])))
    i, j = np.minimum(119, np.floor(120 * th / (2 * math.pi))), np.minimum(59, np.floor(60 * ph / math.pi))
    want = sphere.patch_of_angles(2 * math.pi * i / 120, math.pi * j / 60, sphere.equal_area_patches(60))
    assert (got == want).all() and set(got) == set(range(60))


def test_geodesic_hierarchy():
    for d in (1, 2, 4):
        v, tri = sphere.geodesic(d)
        assert len(tri) == 20 * 4 ** (d - 1) and np.allclose(np.linalg.norm(v, axis=1), 1)
    v4, t4 = sphere.geodesic(4)
    v3, t3 = sphere.geodesic(3)
    mid = v4[t4].mean(1)
    assert (sphere.triangle_of(mid, 4) == np.arange(len(t4))).all()
    assert (sphere.triangle_of(mid, 3) == np.arange(len(t4)) // 4).all()


def test_geodesic_join_equals_descent(spark):
    p = fibonacci(200)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "vec_id long, x double, y double, z double")
    got = [r.bin for r in sphere.geodesic_exact(df, "x", "y", "z", 2, "vec_id").orderBy("vec_id").collect()]
    assert got == sphere.triangle_of(p, 2).tolist()


def test_grid_round_trip(spark):
    g = GridSpec.from_bounds((0.5, 0, 2), (4.2, 3, 6))
    assert g.low == (0, 0, 2) and g.dims == (6, 4, 5) and g.high == (5, 3, 6)
    f = Field.from_ids(spark.range(g.size).select(F.col("id").alias("cell_id"), F.col("id").cast("double").alias("value")), g)
    assert f.df.where(g.cell_id(F.col("x"), F.col("y"), F.col("z")) != F.col("cell_id")).count() == 0
    assert f.between((1, 1, 3), (2, 2, 4)).df.count() == 8 and f.at(7).first().value == 7.0
