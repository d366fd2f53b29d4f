"""Queries that run the end-to-end programs on raster files written from the event grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.args import Args
from ..sources.files import shared_dir
from ..sources.raster import read_raster, strip_header, write_raster
from . import drivers
from .common import CELLS, event_grid, query, rounded, sql_bin, sql_entropy
from .fields import _BLOCK, sql_local, sql_patches


class Files(dict):
    """Paths of files by name; a file is written when it is asked for."""

    def __init__(self, write):
        self.write = write

    def __missing__(self, name: str) -> str:
        self[name] = self.write(name)
        return self[name]


def files(spark, d) -> dict[str, str]:
    """Two scalar rasters (a.vol, b.vol) and two vector rasters (u.vec, v.vec) over the grid of events."""
    df, g = event_grid(spark, d)
    root = shared_dir(spark, "program")
    x, y, z, v = F.col("x"), F.col("y"), F.col("z"), F.col("value")
    values = {
        "a.vol": (F.floor("value"),), "b.vol": (F.col("user_id") % 50,),
        "u.vec": (x - 4.5, y - 4.5, F.floor(v) % 11 - 5.25), "v.vec": (F.floor(v) % 7 - 3.25, x - y + 0.5, z % 5 - 2.25),
    }

    def write(name: str) -> str:
        c = values[name]
        value = c[0] if len(c) == 1 else F.struct(*[e.cast("double").alias(n) for n, e in zip("xyz", c)])
        write_raster(df.select("cell_id", value.alias("value")), f"{root}/{name}", g.dims, components=len(c))
        return f"{root}/{name}"

    return Files(write)


_F = "f AS (SELECT x, y, z, cell_id, floor(value) AS a, CAST(user_id % 50 AS DOUBLE) AS b FROM cells), ra AS (SELECT min(a) AS lo, max(a) AS hi FROM f), rb AS (SELECT min(b) AS lo, max(b) AS hi FROM f)"


@query("m1_m2_scalar_global", f"WITH {CELLS}, {_F}, h AS (SELECT {sql_bin('a', 100)} AS bin, count(*) AS n FROM f, ra GROUP BY 1) {sql_entropy('h')}")
def m1(spark, d):
    return rounded(drivers.run(spark, Args(functionType="1", scalarField=files(spark, d)["a.vol"], nBin="100", nBlock="2"), "scalar"), "entropy")


@query("m3_m14_scalar_blockwise", f"WITH {CELLS}, {_F}, {_BLOCK}, h AS (SELECT CAST((z // 5) * 4 + (y // 5) * 2 + x // 5 AS INTEGER) AS block_id, {sql_bin('a', 100, '0.0', '255.0')} AS bin, count(*) AS n FROM f GROUP BY ALL) {sql_entropy('h', 'block_id')}")
def m3(spark, d):
    _, g = event_grid(spark, d)
    args = Args(functionType="2", scalarField=files(spark, d)["a.vol"], nBin="100", histLow="0", histHigh="255", nPartX="2", nPartY="2", nPartZ=str(-(-g.dims[2] // 5)))
    return rounded(drivers.run(spark, args, "scalar").select("block_id", "entropy"), "entropy")


@query("m4_m16_scalar_local", f"WITH {CELLS}, {_F}, c AS (SELECT x, y, z, {sql_bin('a', 32)} AS bin FROM f, ra), {sql_local('c')}")
def m4(spark, d):
    """The written raster is read back, as a float field."""
    f = files(spark, d)
    out = f["a.vol"] + ".entropy"
    got = drivers.run(spark, Args(functionType="3", scalarField=f["a.vol"], nBin="32", outField=out), "scalar").select("cell_id", "entropy")
    back = read_raster(spark, out).select("cell_id", F.col("value").alias("stored"))
    both = got.join(back, "cell_id").where(F.abs(F.col("entropy") - F.col("stored")) < 1e-5)
    return rounded(both.select("cell_id", "entropy"), "entropy")


@query("m5_scalar_local_normalised", f"WITH {CELLS}, {_F}, c AS (SELECT x, y, z, {sql_bin('a', 32)} AS bin FROM f, ra), {sql_local('c', norm=32)}")
def m5(spark, d):
    return rounded(drivers.run(spark, Args(functionType="4", scalarField=files(spark, d)["a.vol"], nBin="32"), "scalar").select("cell_id", "entropy"), "entropy")


@query("m6_scalar_joint", f"WITH {CELLS}, {_F}, h AS (SELECT {sql_bin('b', 20, 'rb.lo', 'rb.hi')} * 20 + {sql_bin('a', 20, 'ra.lo', 'ra.hi')} AS bin, count(*) AS n FROM f, ra, rb GROUP BY 1) {sql_entropy('h')}")
def m6(spark, d):
    f = files(spark, d)
    return rounded(drivers.run(spark, Args(functionType="5", scalarField=f["a.vol"], scalarField2=f["b.vol"], nBin="20"), "scalar"), "entropy")


@query("m7_vector_global")
def m7(spark, d):
    return rounded(drivers.run(spark, Args(functionType="0", vectorField=files(spark, d)["u.vec"], nDivision="4"), "vector"), "entropy")


@query("m8_vector_local")
def m8(spark, d):
    return rounded(drivers.run(spark, Args(functionType="4", vectorField=files(spark, d)["u.vec"], nDivision="2", neighborhoodSize="1"), "vector").select("cell_id", "entropy"), "entropy")


def _patch(name: str, x: str, y: str, z: str) -> str:
    """Patch of 24 of a vector of each cell through the table of 48 x 24 directions."""
    th = f"2 * pi() * least(47, floor(48 * (CASE WHEN {x} = 0 AND {y} = 0 THEN 0 ELSE pi() + atan2({y}, {x}) END) / (2 * pi()))) / 48"
    ph = f"pi() * least(23, floor(24 * abs(pi() / 2 - atan2({z}, sqrt({x} * {x} + {y} * {y}))) / pi())) / 24"
    return f"t{name} AS (SELECT cell_id, {th} AS th, {ph} AS ph FROM c3), {name} AS (SELECT cell_id, CAST(min(id) AS INTEGER) AS bin FROM t{name} JOIN p ON ph BETWEEN c AND d AND (th BETWEEN a AND b OR th + 2 * pi() BETWEEN a AND b) GROUP BY cell_id)"


_M9 = "c3 AS (SELECT cell_id, x - 4.5 AS ux, y - 4.5 AS uy, floor(value) % 11 - 5.25 AS uz, floor(value) % 7 - 3.25 AS vx, x - y + 0.5 AS vy, z % 5 - 2.25 AS vz FROM cells)"


@query("m9_vector_joint_local", f"WITH {CELLS}, {sql_patches(24)}, {_M9}, {_patch('q1', 'ux', 'uy', 'uz')}, {_patch('q2', 'vx', 'vy', 'vz')}, c2 AS (SELECT x, y, z, q2.bin * 24 + q1.bin AS bin FROM cells JOIN q1 USING (cell_id) JOIN q2 USING (cell_id)), {sql_local('c2')}")
def m9(spark, d):
    f = files(spark, d)
    return rounded(drivers.run(spark, Args(functionType="6", vectorField=f["u.vec"], vectorField2=f["v.vec"], nBin="24", neighborhoodSize="1"), "vector").select("cell_id", "entropy"), "entropy")


@query("m10_strip_header", f"WITH {CELLS} SELECT count(*) AS n, sum(floor(value)) AS total FROM cells")
def m10(spark, d):
    _, g = event_grid(spark, d)
    path = files(spark, d)["a.vol"]
    strip_header(path, path + ".raw")
    raw = drivers.load(spark, Args(scalarField=path + ".raw", **dict(zip(("nX", "nY", "nZ"), map(str, g.dims)))), "scalarField")[0]
    return raw.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("m12_non_spatial", f"WITH {CELLS}, {_F} SELECT {sql_bin('a', 64)} AS bin, count(*) AS n FROM f, ra GROUP BY 1")
def m12(spark, d):
    return drivers.run(spark, Args(scalarField=files(spark, d)["a.vol"], nBin="64"), "nonspatial")


_M17 = f"k AS (SELECT unnest(range(6)) AS k), fine AS (SELECT {{block}} AS block_id, {sql_bin('a', 256)} AS bin, count(*) AS n FROM f, ra, zm GROUP BY 1, 2), h AS (SELECT block_id, CAST(256 // (2 ** k)::INT AS INTEGER) AS n_bins, bin // (2 ** k)::INT AS bin, sum(n) AS n, any_value((hi - lo) / (256 // (2 ** k)::INT)) AS w FROM fine, k, ra GROUP BY 1, 2, 3), s AS (SELECT block_id, n_bins, (2 - (sum(n) + 1) * (sum(n * n) / (CAST(sum(n) AS DOUBLE) * sum(n)))) / ((sum(n) - 1) * any_value(w)) AS score FROM h GROUP BY 1, 2)"
_EIGHTH = "CAST((z // ((m + 2) // 2)) * 4 + (y // 5) * 2 + x // 5 AS INTEGER)"


@query("m17_cross_validation_halving", f"WITH {CELLS}, {_F}, zm AS (SELECT max(z) AS m FROM cells), {_M17.format(block='0')} SELECT n_bins, round(score, 9) AS score FROM s")
def m17_halving(spark, d):
    args = Args(functionType="1", scalarField=files(spark, d)["a.vol"], nBinStart="256", nIter="6")
    return rounded(drivers.run(spark, args, "crossvalidate"), "score", digits=9)


@query("m17_cross_validation_geodesic")
def m17_geodesic(spark, d):
    args = Args(functionType="1", fieldType="vector", vectorField=files(spark, d)["u.vec"], nDivision="3")
    return rounded(drivers.run(spark, args, "crossvalidate"), "score", digits=9)


@query("m11_mesh_program")
def m11(spark, d):
    """The tetrahedral mesh of the event grid written as text, read and evaluated by the mesh program."""
    from ..sources.tables import write_mesh
    from .meshes import mesh

    path = shared_dir(spark, "mesh") + "/mesh.txt"
    write_mesh(*mesh(spark, d), path)
    return rounded(drivers.run(spark, Args(functionType="1", inputField=path, nBin="64"), "mesh"), "entropy")


@query("m17_cross_validation_blockwise", f"WITH {CELLS}, {_F}, zm AS (SELECT max(z) AS m FROM cells), {_M17.format(block=_EIGHTH)} SELECT block_id, CAST(arg_min(n_bins, score) AS INTEGER) AS n_bins, round(min(score), 9) AS score FROM s GROUP BY block_id")
def m17(spark, d):
    args = Args(functionType="4", scalarField=files(spark, d)["a.vol"], nBinStart="256", nIter="6", nPart="2")
    return rounded(drivers.run(spark, args, "crossvalidate"), "score", digits=9)


@query("m17_cross_validation_linear", f"WITH {CELLS}, {_F}, k AS (SELECT CAST(10 + 10 * unnest(range(6)) AS INTEGER) AS n_bins), h AS (SELECT n_bins, {sql_bin('a', 'n_bins')} AS bin, count(*) AS n, any_value((hi - lo) / n_bins) AS w FROM f, ra, k GROUP BY 1, 2) SELECT n_bins, round((2 - (sum(n) + 1) * (sum(n * n) / (CAST(sum(n) AS DOUBLE) * sum(n)))) / ((sum(n) - 1) * any_value(w)), 9) AS score FROM h GROUP BY n_bins")
def m17_linear(spark, d):
    args = Args(functionType="2", scalarField=files(spark, d)["a.vol"], nBinStart="10", step="10", nIter="6")
    return rounded(drivers.run(spark, args, "crossvalidate"), "score", digits=9)
