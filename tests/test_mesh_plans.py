"""What a mesh query sends through the driver: no table that grows with the mesh is broadcast, however small Spark believes it."""

import pytest

from entrofield.plans import registry


def broadcast(df):
    """Joins of a plan, before it runs, that broadcast more than one row."""
    return [line.strip() for line in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in line]


@pytest.mark.parametrize("name", ["t1_bounding_boxes", "t4_box_relation", "t5_face_neighbours", "t7_cross_sections", "t8_t9_volume_histogram_total", "e11_mesh_entropy_volume", "e11_mesh_entropy_area", "e12_mesh_local_entropy", "t6_sorted_values"])
def test_no_table_is_broadcast(spark, sf, name):
    assert broadcast(registry.QUERIES[name](spark, sf)) == []


def test_faces_of_more_and_of_odd_cells(spark):
    """A face of three cells gives all their pairs; a cell with a vertex twice is no neighbour of its own."""
    from entrofield.operators import tetmesh

    c = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [2, 1, 0, 4]), (2, [5, 0, 2, 1]), (3, [7, 7, 8, 9])], "cid long, v array<long>")
    got = sorted(map(tuple, tetmesh.face_neighbours(c).collect()))
    assert got == [(0, 3, 1), (0, 3, 2), (1, 3, 0), (1, 3, 2), (2, 0, 0), (2, 0, 1)]


def test_parts_say_the_same_as_columns(spark):
    """What cells add to bins by arrays and by the spline's columns; values far off 0, some equal."""
    import numpy as np
    from pyspark.sql import functions as F

    from entrofield.operators import tetmesh

    rng = np.random.default_rng(3)
    c = rng.random((40, 4, 4)) * [2, 3, 1, 50] + [0, 0, 9, 1e4]
    c[:10, 1, 3], c[:5, 2, 3], c[0, :, 3] = c[:10, 0, 3], c[:5, 0, 3], 1e4 + 7
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in t]) for i, t in enumerate(c)], "cid long, corners array<struct<x:double,y:double,z:double,f:double>>")
    vol, grad = tetmesh.volume_and_gradient(F.col("corners"))
    s = tetmesh.ordered(F.col("corners"))
    edges = np.linspace(1e4 + 5, 1e4 + 45, 9)
    low, high = np.r_[-1e9, edges[1:-1]], np.r_[edges[1:-1], 1e9]
    some = df.select("cid", vol.alias("volume"), (vol * grad).alias("area"), *[s[i]["f"].alias(f"f{i}") for i in range(4)])
    f = [F.col(f"f{i}") for i in range(4)]
    want = some.select("cid", "volume", "area", *[F.when(f[0] == f[3], F.lit(None)).otherwise(tetmesh.contribution(f, F.greatest(F.lit(float(a)), f[0]), F.least(F.lit(float(b)), f[3]))).alias(f"b{k}") for k, (a, b) in enumerate(zip(low, high))]).toPandas().sort_values("cid")
    for weight in ("volume", "area"):
        got = np.zeros((40, 8))
        for row, b, w in tetmesh.parts(c, 8, weight, edges[0], edges[-1]):
            got[row, b] += w
        np.testing.assert_allclose(got[1:], (want[[f"b{k}" for k in range(8)]].to_numpy() * want[[weight]].to_numpy())[1:], atol=1e-5)
        assert got[0].sum() == (pytest.approx(want.volume[0]) if weight == "volume" else 0) and np.count_nonzero(got[0]) <= 1


def test_undefined_values_are_dropped(spark):
    """A cell with a null or undefined corner counts nowhere, and doesn't touch the range."""
    from entrofield.operators import tetmesh

    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 2.0), (2, 0.0, 1.0, 0.0, 3.0), (3, 0.0, 0.0, 1.0, 5.0), (4, 1.0, 1.0, 1.0, float("nan")), (5, 2.0, 1.0, 1.0, None)], "vid long, x double, y double, z double, f double")
    c = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [1, 2, 3, 4]), (2, [1, 2, 3, 5])], "cid long, v array<long>")
    h = {r.bin: r.n for r in tetmesh.global_histogram(v, c, 4, "volume").collect()}
    assert sorted(h) == [0, 1, 2, 3] and sum(h.values()) == pytest.approx(1 / 6)


def test_corners_are_gathered_once(spark, sf):
    """The mesh program's histogram doesn't join the corners a second time for their range."""
    plan = registry.QUERIES["m11_mesh_program"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
