"""End-to-end runs from a configuration: read a field, map it to bins, evaluate, optionally write.

A run is described by the keys of a configuration file (see sources.args): functionType, inputField / scalarField / vectorField (and ...2), fieldType, nBin, histLow, histHigh, neighborhoodSize[X|Y|Z], nBlock[X|Y|Z],
nPart[X|Y|Z], nDivision, nBinStart, nIter, step, outField, nX, nY, nZ for files without a header, patchFile. Serial and distributed modes of one evaluation are the same plan here; they differ in how the file is cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import blocks as K
from ..operators import density, sphere, stencil, tetmesh
from ..operators import entropy as E
from ..operators.grid import GridSpec
from ..sources.args import Args
from ..sources.raster import RasterReader, read_raster, write_raster
from ..sources.tables import read_mesh


def _three(args: Args, name: str, default: int) -> tuple[int, int, int]:
    one = int(args[name] or default)
    return tuple(int(args[f"{name}{c}"] or one) for c in "XYZ")


def _options(args: Args, components: int) -> dict:
    out = {"components": components, "blocks": ",".join(map(str, _three(args, "nBlock", 1)))}
    if args["nX"]:
        out |= {"header": "false", "dims": ",".join(args[k] for k in ("nX", "nY", "nZ"))}
    return out


def load(spark: SparkSession, args: Args, key: str, components: int = 1) -> tuple[DataFrame, GridSpec]:
    """Cells of a raster and its grid; infinite values become 0."""
    path, options = args[key] or args["inputField"], _options(args, components)
    df = read_raster(spark, path, **options).drop("block_id", "is_ghost")
    if components == 1:
        from ..functions.scalar import finite

        df = df.withColumn("value", finite(F.col("value").cast("double")))
    return df, GridSpec(RasterReader({"path": path, **options}).shape())


def given_range(args: Args, suffix: str = "") -> B.Range:
    lo, hi = args[f"histLow{suffix}"], args[f"histHigh{suffix}"]
    return (float(lo), float(hi)) if lo and hi else "global"


def vector_bins(df: DataFrame, args: Args) -> tuple[DataFrame, int]:
    """Sphere bins of a vector field: geodesic triangles with nDivision, else equal-area patches."""
    xyz = [F.col("value")[c].cast("double") for c in "xyz"]
    if args["nDivision"]:
        d = int(args["nDivision"])
        return df.withColumn("bin", sphere.geodesic_bin(*xyz, d)), 20 * 4 ** (d - 1)
    n = int(args["nBin"] or 360)
    return df.withColumn("bin", sphere.patch_bin(*xyz, n)), n


def binned(spark: SparkSession, args: Args, kind: str, suffix: str = "") -> tuple[DataFrame, GridSpec, int]:
    if kind == "vector":
        df, grid = load(spark, args, f"vectorField{suffix}", 3)
        df, n = vector_bins(df, args)
        return df, grid, n
    df, grid = load(spark, args, f"scalarField{suffix}")
    n = int(args["nBin"] or B.default_bins(grid.size))
    return B.with_bin(df, n, range_=given_range(args, suffix)), grid, n


def global_entropy(spark: SparkSession, args: Args, kind: str = "scalar", normalize: bool = False) -> DataFrame:
    df, _, n = binned(spark, args, kind)
    return E.of_bins(df, n_bins=n if normalize else None)


def blockwise_entropy(spark: SparkSession, args: Args, kind: str = "scalar", shared: bool = False) -> DataFrame:
    """Block report over nPart blocks per axis; shared blocks overlap by their boundary."""
    df, grid, n = binned(spark, args, kind)
    parts = _three(args, "nPart", 1)
    cut = K.shared_blocks(df, grid, parts) if shared else K.with_block(df, grid, parts)
    return K.block_report(cut, n)


def local_entropy(spark: SparkSession, args: Args, kind: str = "scalar", normalize: bool = False) -> DataFrame:
    df, grid, n = binned(spark, args, kind)
    return _written(stencil.local_entropy(df, grid, _three(args, "neighborhoodSize", 1), n, normalize), args, grid)


def _joint(spark: SparkSession, args: Args, kind: str) -> tuple[DataFrame, GridSpec, int]:
    a, grid, n = binned(spark, args, kind)
    b, _, _ = binned(spark, args, kind, "2")
    both = a.join(b.select("cell_id", F.col("bin").alias("_b2")), "cell_id")
    return both.withColumn("bin", F.col("_b2") * n + F.col("bin")), grid, n


def joint_entropy(spark: SparkSession, args: Args, kind: str = "scalar") -> DataFrame:
    return E.of_bins(_joint(spark, args, kind)[0])


def local_joint_entropy(spark: SparkSession, args: Args, kind: str = "vector") -> DataFrame:
    df, grid, n = _joint(spark, args, kind)
    return _written(stencil.local_entropy(df, grid, _three(args, "neighborhoodSize", 1), n * n), args, grid)


def _written(df: DataFrame, args: Args, grid: GridSpec) -> DataFrame:
    """The entropy field, also as a raster if the configuration names one."""
    if args["outField"]:
        write_raster(df.select("cell_id", F.col("entropy").alias("value")), args["outField"], grid.dims)
    return df


def mesh_entropy(spark: SparkSession, args: Args, local: bool = True) -> DataFrame:
    v, c = read_mesh(spark, args["inputField"])
    n = int(args["nBin"] or 1000)
    return tetmesh.local_entropy(v, c, float(args["radius"]), n) if local else tetmesh.global_entropy(v, c, n)


def non_spatial(spark: SparkSession, args: Args, kind: str = "scalar") -> DataFrame:
    """Frequencies only."""
    return E.counts(binned(spark, args, kind)[0])


def cross_validation(spark: SparkSession, args: Args, kind: str = "scalar", method: str = "halving") -> DataFrame:
    """Scores per bin count: linear sweep, halving sweep, geodesic hierarchy, or the halving sweep of each block (best count only)."""
    n, start, step = int(args["nIter"] or 1), int(args["nBinStart"] or 2), int(args["step"] or 1)
    if kind == "vector":
        d = int(args["nDivision"])
        df, _ = load(spark, args, "vectorField", 3)
        return density.geodesic_sweep(vector_bins(df, args)[0], "bin", d)
    df, grid = load(spark, args, "scalarField")
    if method == "linear":
        return density.linear_sweep(df, "value", start, step, n, given_range(args))
    if method == "halving":
        return density.halving_sweep(df, "value", start, n, given_range(args))
    cut = K.with_block(df, grid, _three(args, "nPart", 1))
    return density.best(density.halving_sweep(cut, "value", start, n, given_range(args), ["block_id"]), ["block_id"])


#: functionType of the scalar and vector programs.
SCALAR = {0: global_entropy, 1: global_entropy, 2: blockwise_entropy, 3: local_entropy, 4: lambda s, a, k: local_entropy(s, a, k, True), 5: joint_entropy}
VECTOR = {0: global_entropy, 1: global_entropy, 2: blockwise_entropy, 3: lambda s, a, k: local_entropy(s, a, k, True), 4: lambda s, a, k: local_entropy(s, a, k, True), 5: local_joint_entropy, 6: local_joint_entropy}
CROSS = {0: "linear", 1: "halving", 2: "linear", 3: "halving", 4: "blockwise"}


def run(spark: SparkSession, args: Args, program: str) -> DataFrame:
    """program: scalar, vector, mesh, nonspatial or crossvalidate; functionType chooses the mode."""
    mode = int(args["functionType"] or 0)
    if program == "scalar":
        return SCALAR[mode](spark, args, "scalar")
    if program == "vector":
        return VECTOR[mode](spark, args, "vector")
    if program == "mesh":
        return mesh_entropy(spark, args, local=mode == 0)
    kind = "vector" if args["fieldType"] in ("1", "vector") else "scalar"
    if program == "nonspatial":
        return non_spatial(spark, args, kind)
    if program == "crossvalidate":
        return cross_validation(spark, args, kind, CROSS[mode])
    raise ValueError(f"unknown program {program!r}")

