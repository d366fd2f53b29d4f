import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entrofield.operators import blocks, density, randomfield, resample, stencil, tetmesh, tree
from entrofield.operators.grid import GridSpec


def cells(spark, a):
    """A numpy array (z, y, x) of bins as rows."""
    rows = [(int(x), int(y), int(z), int(a[z, y, x])) for z, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, bin int").repartition(3), GridSpec(a.shape[::-1])


def brute_local(a, r, mode):
    ax = [stencil.padded(n, k, mode) for n, k in zip(a.shape, r[::-1])]
    big = a[np.ix_(*ax)]
    out = np.zeros(a.shape)
    for z, y, x in np.ndindex(a.shape):
        box = big[z : z + 2 * r[2] + 1, y : y + 2 * r[1] + 1, x : x + 2 * r[0] + 1]
        p = np.unique(box, return_counts=True)[1] / box.size
        out[z, y, x] = -(p * np.log2(p)).sum()
    return out


@pytest.mark.parametrize("mode", stencil.MODES)
@pytest.mark.parametrize("r", [(1, 1, 1), (2, 0, 1), (3, 2, 3)])
def test_local_entropy_equals_brute_force(spark, mode, r):
    a = np.random.default_rng(1).integers(0, 5, (7, 8, 9))
    df, g = cells(spark, a)
    want = brute_local(a, r, mode)
    for out in (stencil.local_entropy(df, g, r, 5, mode=mode), stencil.local_entropy(df, g, r, 5, mode=mode, block=4)):
        got = {(q.z, q.y, q.x): q.entropy for q in out.collect()}
        assert len(got) == a.size and all(abs(got[k] - want[k]) < 1e-6 for k in np.ndindex(a.shape))


def test_both_stencil_ways_agree(spark):
    a = np.random.default_rng(2).integers(0, 4, (6, 6, 6))
    df, g = cells(spark, a)
    one = {r.cell_id: r.entropy for r in stencil.local_entropy(df, g, 1, 4, normalize=True).collect()}
    local = df.select("x", "y", "z", "bin")
    two = {(r.z * 6 + r.y) * 6 + r.x: r.entropy for r in stencil.exploded(local, g, (1, 1, 1), 27, 4, True, "mirror").collect()}
    assert len(one) == len(two) == 216 and all(abs(one[k] - two[k]) < 1e-6 for k in one)


@pytest.mark.parametrize("r", [(1, 1, 1), (0, 2, 1)])
def test_many_bins_are_sorted(spark, r, monkeypatch):
    """More bins than a box has cells: the sorted way, in pieces, equals running sums and brute force."""
    monkeypatch.setattr(stencil, "SORTED", 100)
    a = np.random.default_rng(3).integers(0, 400, (7, 8, 9)) // 5
    df, g = cells(spark, a)
    want = brute_local(a, r, "mirror")
    got = {(q.z, q.y, q.x): q.entropy for q in stencil.local_entropy(df, g, r, 80).collect()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in np.ndindex(a.shape))
    size = (2 * r[0] + 1) * (2 * r[1] + 1) * (2 * r[2] + 1)
    assert np.allclose(stencil.sorted_entropy(a, r, 80, True), stencil.box_entropy(a, r, 80, True), atol=1e-6) and size < 80


def test_axis_too_short(spark):
    df, g = cells(spark, np.zeros((4, 4, 4), int))
    with pytest.raises(ValueError):
        stencil.local_entropy(df, g, 3, 2)


@pytest.mark.parametrize("split", ["ceil", "floor"])
def test_ghost_cells(spark, split):
    df, g = cells(spark, np.zeros((7, 5, 6), int))
    got = blocks.ghost_blocks(df, g, (2, 1, 3), 1, split).toPandas()
    own = got[~got.is_ghost]
    assert len(own) == 7 * 5 * 6 and not own.duplicated(["x", "y", "z"]).any()
    lim = own.groupby("block_id").agg(lx=("x", "min"), hx=("x", "max"), lz=("z", "min"), hz=("z", "max"))
    for b, rows in got.groupby("block_id"):
        q = lim.loc[b]
        want = (min(5, q.hx + 1) - max(0, q.lx - 1) + 1) * 5 * (min(6, q.hz + 1) - max(0, q.lz - 1) + 1)
        assert len(rows) == want


def test_cross_validation_prefers_structure(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 1, 3000)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = {r.n_bins: r.score for r in density.halving_sweep(df, "v", 512, 9).collect()}
    for n, score in s.items():
        c = np.histogram(v, n)[0]
        p = c / len(v)
        assert score == pytest.approx((2 - (len(v) + 1) * (p**2).sum()) / ((len(v) - 1) * (v.max() - v.min()) / n), abs=2e-4)
    best = density.best(density.halving_sweep(df, "v", 512, 9)).first().n_bins
    assert best == min(s, key=s.get) and 8 <= best <= 128


def test_kernel_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(0, 1, 2000)], "v double")
    pts = density.kde(df, "v", 400, "silverman").orderBy("i").toPandas()
    assert np.trapezoid(pts.density, pts.x) == pytest.approx(1, abs=0.02)


def test_kde_entropy_cells(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(0, 1, 1500)], "v double")
    a, b = [f(df, "v", "silverman").first().entropy for f in (density.kde_entropy, density.kde_entropy_binned)]
    assert a == pytest.approx(b, abs=1e-4) and a <= math.log2(1500) + 1e-9


# ---------------------------------------------------------------- trees


def test_octree_matches_boxes(spark):
    a = np.random.default_rng(3).integers(0, 6, (9, 9, 9))
    df, g = cells(spark, a)
    t = tree.build(df, ((0, 0, 0), (8, 8, 8)), "octree", 6, 2, min_cells=2)
    nodes = t.frame(spark).toPandas()
    assert len(nodes) == 73 and (nodes.node_id == range(73)).all()
    for n in nodes.itertuples():
        box = a[n.lz : n.hz + 1, n.ly : n.hy + 1, n.lx : n.hx + 1]
        p = np.unique(box, return_counts=True)[1] / box.size
        assert n.cells == box.size and n.entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
    assert t.leaves(spark).count() == 64
    kids = nodes[nodes.parent_id == 0]
    assert kids.iloc[0][["lx", "ly", "lz"]].tolist() == [0, 0, 0] and kids.iloc[2][["lx", "ly", "hx", "hy"]].tolist() == [4, 4, 8, 8]


def test_entropy_split_finds_the_border(spark):
    """Half of the field is constant, half is noise: the largest child entropy is that of the noise alone."""
    a = np.zeros((4, 20, 20), int)
    a[:, :, 10:] = np.random.default_rng(4).integers(0, 8, (4, 20, 10))
    df, _ = cells(spark, a)
    nodes = tree.build(df, ((0, 0, 0), (19, 19, 3)), "max_entropy", 8, 1).frame(spark).toPandas()
    assert nodes.iloc[2].lx >= 9 and nodes.iloc[2].entropy > 2.8


def test_minima_and_modes(spark):
    assert tree.minima([5, 4, 3, 4, 5, 4, 4.5]) == [2, 5] and tree.minima([1, 2, 3]) == []
    df, _ = cells(spark, np.zeros((4, 4, 4), int))
    assert tree.build(df, ((0, 0, 0), (3, 3, 3)), "distance", 4, 3).frame(spark).count() == 1
    assert tree.build(df, ((0, 0, 0), (3, 3, 3)), "quadtree", 4, 1).frame(spark).count() == 5
    with pytest.raises(ValueError):
        tree.build(df, ((0, 0, 0), (3, 3, 3)), "bsp", 4, 1)


# ---------------------------------------------------------------- meshes


@pytest.fixture(scope="module")
def mesh(spark):
    from entrofield.plans.meshes import KUHN

    n, f = 4, lambda x, y, z: 0.3 * x - 0.7 * y + 1.1 * z
    v = [((z * n + y) * n + x, float(x), float(y), float(z), f(x, y, z)) for z in range(n) for y in range(n) for x in range(n)]
    c = []
    for z, y, x in np.ndindex(n - 1, n - 1, n - 1):
        base = (z * n + y) * n + x
        c += [(len(c) + k, [base + (q & 1) + n * (q >> 1 & 1) + n * n * (q >> 2) for q in t]) for k, t in enumerate(KUHN)]
    return spark.createDataFrame(v, "vid long, x double, y double, z double, f double"), spark.createDataFrame(c, "cid long, v array<long>")


def test_isovolume_totals(mesh):
    """Volume adds up to the cube; area over values to the gradient times the volume (co-area)."""
    grad = math.sqrt(0.09 + 0.49 + 1.21)
    for weight, want in (("volume", 27.0), ("area", 27.0 * grad)):
        for n in (1, 7, 50):
            assert tetmesh.global_histogram(*mesh, n, weight).agg(F.sum("n")).first()[0] == pytest.approx(want, rel=1e-9)


def test_isovolume_bins_against_sampling(mesh):
    got = {r.bin: r.n for r in tetmesh.global_histogram(*mesh, 12, "volume").collect()}
    p = np.random.default_rng(5).random((400_000, 3)) * 3
    f = p @ [0.3, -0.7, 1.1]
    lo, hi = -2.1, 4.2
    want = np.bincount(np.clip(((f - lo) / ((hi - lo) / 12)).astype(int), 0, 11), minlength=12) / len(p) * 27
    assert np.abs(np.array([got[i] for i in range(12)]) - want).max() < 0.05


def test_degenerate_cells(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0, 3.0)], "vid long, x double, y double, z double, f double")
    c = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [1, 2, 3, 4])], "cid long, v array<long>")
    h = {r.bin: r.n for r in tetmesh.global_histogram(v, c, 4, "volume").collect()}
    assert sum(h.values()) == pytest.approx(1 / 6 + 1 / 3)
    assert sum(r.n for r in tetmesh.global_histogram(v, c, 4, "area").collect()) > 0


def test_spline_pieces_meet(spark):
    """The density is continuous at the knots and integrates to one."""
    f = [F.lit(x) for x in (0.0, 0.7, 1.1, 2.0)]
    q = tetmesh.spline(f)
    at = lambda k, t: q[k][0] * t * t + q[k][1] * t + q[k][2]
    row = spark.range(1).select(at(0, 0.7).alias("a"), at(1, 0.7).alias("b"), at(1, 1.1).alias("c"), at(2, 1.1).alias("d"), tetmesh.contribution(f, F.lit(-1.0), F.lit(5.0)).alias("one")).first()
    assert row.a == pytest.approx(row.b) and row.c == pytest.approx(row.d) and row.one == pytest.approx(1)


def test_cross_sections_match_the_density(mesh):
    """Isosurface area at the middle knots equals gradient times volume density there."""
    m = tetmesh.with_corners(*mesh).withColumn("s", tetmesh.ordered(F.col("corners")))
    vol, grad = tetmesh.volume_and_gradient(F.col("corners"))
    f = [F.col("s")[i]["f"] for i in range(4)]
    q = tetmesh.spline(f)
    d = lambda k, t: q[k][0] * t * t + q[k][1] * t + q[k][2]
    rows = m.select(tetmesh.cross_section(F.col("s"), 1).alias("a"), (vol * grad * d(1, f[1])).alias("b"), tetmesh.cross_section(F.col("s"), 2).alias("c"), (vol * grad * d(1, f[2])).alias("d")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-6) and r.c == pytest.approx(r.d, abs=1e-6) for r in rows)


def test_relation_and_neighbours(mesh):
    v, c = mesh
    rel = tetmesh.box_relation(v, tetmesh.bounding_boxes(tetmesh.with_corners(v, c)), 1.2).toPandas()
    assert not rel.duplicated(["vid", "cid"]).any()
    box = tetmesh.bounding_boxes(tetmesh.with_corners(v, c)).toPandas()
    for p in v.collect()[::7]:
        hit = box
        for a, q in zip("xyz", (p.x, p.y, p.z)):
            hit = hit[(hit[f"l{a}"] < q + 1.2) & (hit[f"h{a}"] > q - 1.2)]
        assert set(hit.cid) == set(rel.cid[rel.vid == p.vid])
    n = tetmesh.face_neighbours(c)
    assert n.groupBy("cid", "face").count().agg(F.max("count")).first()[0] == 1


def test_local_mesh_entropy(mesh):
    out = tetmesh.local_entropy(*mesh, 1.5, 8).toPandas()
    assert len(out) == 64 and out.entropy.between(0, 3.0001).all()


# ---------------------------------------------------------------- others


def test_resample_recovers_grid_points(spark):
    rng = random.Random(1)
    pts = [(x + rng.uniform(-0.2, 0.2), y + rng.uniform(-0.2, 0.2), z + rng.uniform(-0.2, 0.2)) for x in range(5) for y in range(4) for z in range(3)]
    df = spark.createDataFrame([(*p, 2.0) for p in pts], "x double, y double, z double, value double")
    got = resample.resample(df, GridSpec((5, 4, 3)), (0, 0, 0), (1, 1, 1), 0.5)
    assert got.count() == 60 and got.where("abs(value - 2) > 1e-9").count() == 0


def test_session_tables(spark, tmp_path):
    df = spark.createDataFrame([(t, b, x, 0, 0, float(x + b), 1.0) for t in range(2) for b in range(3) for x in range(8)], "time_step int, block_id int, x int, y int, z int, u double, v double")
    with randomfield.Session(" my run! ", f"file://{tmp_path}") as s:
        f = s.add(df).component("u", lo=0, hi=9).component("v").as_scalar("u", "u", lo=0.0, hi=8.0, n_bins=8).as_vector2("dir", ["u", "v"], n_bins=12)
        f.rectangular_coordinates(0, df.select("time_step", "block_id", F.col("x").alias("i"), (F.col("x") * 0.5).alias("coord")))
        for _ in range(2):  # a repeated dump leaves one copy
            s.write_data(f.at_step(1))
            s.write_samples(f)
            s.write_geometry(f)
            s.write_entropy(f, "u")
    assert s.path.endswith("my_run") and s.read(spark, "data").count() == 24
    assert s.read(spark, "rv").count() == 48 and s.read(spark, "entropy").count() == 6
    h = {(r.time_step, r.block_id): r.entropy for r in f.entropy("u").collect()}
    assert h[0, 0] == pytest.approx(3.0)
    assert f.local_entropy("u", GridSpec((8, 1, 1)), 1, 0, 0).count() == 8
    assert f.joint_entropy("u", "dir").count() == 6
