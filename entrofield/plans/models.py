"""Queries over densities, cross-validation, resampling, raster files, meshes of bins and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, sphere
from ..operators.grid import GridSpec
from ..operators.resample import resample
from ..sources.files import shared_dir
from ..streaming.entropy import windowed_entropy
from .common import CELLS, event_grid, query, rounded, sql_bin, table, vectors

_STAT = "s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n, var_pop(value) AS var FROM events)"


@query("kd1_kernel_density", f"WITH {_STAT}, h AS (SELECT *, 1.06 * var * n ** -0.2 AS h FROM s), p AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 63 AS x FROM h, (SELECT unnest(range(64)) AS i)) SELECT i, round(x, 6) AS x, round(sum(exp(0 - ((x - value) / h) ** 2 / 2) / (h * sqrt(2 * pi()))) / count(*), 9) AS density FROM p, h, events GROUP BY i, x")
def kd1(spark, d):
    return rounded(rounded(density.kde(table(spark, d, "events"), "value", 64), "x"), "density", digits=9)


@query("kd1_silverman", f"WITH {_STAT}, h AS (SELECT *, 1.06 * sqrt(var) * n ** -0.2 AS h FROM s), p AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 31 AS x FROM h, (SELECT unnest(range(32)) AS i)) SELECT i, round(x, 6) AS x, round(sum(exp(0 - ((x - value) / h) ** 2 / 2) / (h * sqrt(2 * pi()))) / count(*), 9) AS density FROM p, h, events GROUP BY i, x")
def kd1_silverman(spark, d):
    return rounded(rounded(density.kde(table(spark, d, "events"), "value", 32, "silverman"), "x"), "density", digits=9)


@query("kd2_gaussian_kernel", "SELECT event_id, round(exp(0 - ((value - 100.0) / 50.0) ** 2 / 2) / (50.0 * sqrt(2 * pi())), 9) AS k FROM events")
def kd2(spark, d):
    return table(spark, d, "events").select("event_id", F.round(density.gaussian(F.col("value"), 100.0, 50.0), 9).alias("k"))


@query("e5_kde_entropy", "WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS w FROM lineitem GROUP BY 1), s AS (SELECT sum(w) AS n, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 AS var FROM v), h AS (SELECT n, 1.06 * sqrt(var) * n ** -0.2 AS h FROM s), d AS (SELECT a.v, a.w, sum(b.w * exp(0 - ((a.v - b.v) / h) ** 2 / 2) / (h * sqrt(2 * pi()))) / any_value(n) AS d FROM v a, v b, h GROUP BY a.v, a.w), t AS (SELECT sum(w * d) AS t FROM d) SELECT round(-sum(w * (d / t) * log2(d / t)), 6) AS entropy FROM d, t")
def e5(spark, d):
    return rounded(density.kde_entropy(table(spark, d, "lineitem"), "l_quantity", "silverman"), "entropy")


@query("e5_kde_entropy_continuous", "WITH v AS (SELECT value AS v, count(*) AS w FROM events GROUP BY 1), h AS (SELECT count(*) AS n, 1.06 * stddev_pop(value) * count(*) ** -0.2 AS h FROM events), d AS (SELECT a.v, a.w, sum(b.w * exp(0 - ((a.v - b.v) / h) ** 2 / 2) / (h * sqrt(2 * pi()))) / any_value(n) AS d FROM v a, v b, h GROUP BY a.v, a.w), t AS (SELECT sum(w * d) AS t FROM d) SELECT round(-sum(w * (d / t) * log2(d / t)), 6) AS entropy FROM d, t")
def e5_continuous(spark, d):
    return rounded(density.kde_entropy(table(spark, d, "events"), "value", "silverman"), "entropy")


@query("e5_kde_entropy_binned")
def e5_binned(spark, d):
    return rounded(density.kde_entropy_binned(table(spark, d, "lineitem"), "l_extendedprice", "silverman"), "entropy")


_SCORE = "SELECT n_bins, round((2 - (sum(n) + 1) * (sum(n * n) / (CAST(sum(n) AS DOUBLE) * sum(n)))) / ((sum(n) - 1) * any_value(w)), 9) AS score FROM {h} GROUP BY n_bins"
_LINEAR = f"r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), k AS (SELECT CAST(20 + 20 * unnest(range(10)) AS INTEGER) AS n_bins), h AS (SELECT n_bins, {sql_bin('l_extendedprice', 'n_bins')} AS bin, count(*) AS n, any_value((hi - lo) / n_bins) AS w FROM lineitem, r, k GROUP BY 1, 2)"
_HALF = f"r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), f AS (SELECT {sql_bin('l_extendedprice', 1024)} AS bin, count(*) AS n FROM lineitem, r GROUP BY 1), k AS (SELECT unnest(range(8)) AS k), h AS (SELECT CAST(1024 // (2 ** k)::INT AS INTEGER) AS n_bins, bin // (2 ** k)::INT AS bin, sum(n) AS n, any_value((hi - lo) / (1024 // (2 ** k)::INT)) AS w FROM f, k, r GROUP BY 1, 2)"


@query("cv1_score", f"WITH {_HALF} SELECT * FROM ({_SCORE.format(h='h')}) WHERE n_bins = 256")
def cv1(spark, d):
    return density.halving_sweep(table(spark, d, "lineitem"), "l_extendedprice", 1024, 8).where("n_bins = 256").select("n_bins", F.round("score", 9).alias("score"))


@query("cv2_linear_sweep", f"WITH {_LINEAR} {_SCORE.format(h='h')}")
def cv2(spark, d):
    return rounded(density.linear_sweep(table(spark, d, "lineitem"), "l_extendedprice", 20, 20, 10), "score", digits=9)


@query("cv3_halving_sweep", f"WITH {_HALF} {_SCORE.format(h='h')}")
def cv3(spark, d):
    return rounded(density.halving_sweep(table(spark, d, "lineitem"), "l_extendedprice", 1024, 8), "score", digits=9)


@query("cv3_best_bin_count", f"WITH {_HALF} SELECT n_bins, score FROM ({_SCORE.format(h='h')}) ORDER BY score, n_bins LIMIT 1")
def cv3_best(spark, d):
    return rounded(density.best(density.halving_sweep(table(spark, d, "lineitem"), "l_extendedprice", 1024, 8)), "score", digits=9)


@query("cv4_geodesic_sweep")
def cv4(spark, d):
    b = vectors(spark, d).select(sphere.geodesic_bin(F.col("u"), F.col("v"), F.col("w"), 4).alias("bin"))
    return rounded(density.geodesic_sweep(b, "bin", 4), "score", digits=9)


@query("cv5_blockwise_sweep", f"WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), f AS (SELECT user_id % 5 AS block_id, {sql_bin('value', 256)} AS bin, count(*) AS n FROM events, r GROUP BY 1, 2), k AS (SELECT unnest(range(5)) AS k), h AS (SELECT block_id, CAST(256 // (2 ** k)::INT AS INTEGER) AS n_bins, bin // (2 ** k)::INT AS bin, sum(n) AS n, any_value((hi - lo) / (256 // (2 ** k)::INT)) AS w FROM f, k, r GROUP BY 1, 2, 3), s AS (SELECT block_id, n_bins, (2 - (sum(n) + 1) * (sum(n * n) / (CAST(sum(n) AS DOUBLE) * sum(n)))) / ((sum(n) - 1) * any_value(w)) AS score FROM h GROUP BY 1, 2) SELECT block_id, CAST(arg_min(n_bins, score) AS INTEGER) AS n_bins, round(min(score), 9) AS score FROM s GROUP BY block_id")
def cv5(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("block_id"), "value")
    return rounded(density.best(density.halving_sweep(e, "value", 256, 5, keys=["block_id"]), ["block_id"]), "score", digits=9)


@query("rs1_resample", "WITH p AS (SELECT CAST(event_id % 97 AS DOUBLE) / 10 AS x, CAST((event_id // 7) % 89 AS DOUBLE) / 10 AS y, CAST(event_id % 83 AS DOUBLE) / 10 AS z, value FROM events), g AS (SELECT a.i AS gx, b.i AS gy, c.i AS gz FROM (SELECT unnest(range(10)) AS i) a, (SELECT unnest(range(10)) AS i) b, (SELECT unnest(range(9)) AS i) c), q AS (SELECT gx, gy, gz, value, 1 / greatest((x - gx) ** 2 + (y - gy) ** 2 + (z - gz) ** 2, 1e-12) AS w FROM g JOIN p ON x BETWEEN gx - 0.5 AND gx + 0.5 AND y BETWEEN gy - 0.5 AND gy + 0.5 AND z BETWEEN gz - 0.5 AND gz + 0.5) SELECT CAST((gz * 10 + gy) * 10 + gx AS BIGINT) AS cell_id, round(sum(w * value) / sum(w), 5) AS value FROM q GROUP BY gx, gy, gz")
def rs1(spark, d):
    e = table(spark, d, "events")
    p = e.select((F.col("event_id") % 97 / 10).alias("x"), (F.floor(F.col("event_id") / 7) % 89 / 10).alias("y"), (F.col("event_id") % 83 / 10).alias("z"), "value")
    return rounded(resample(p, GridSpec((10, 10, 9)), (0, 0, 0), (1, 1, 1), 0.5).select("cell_id", "value"), "value", digits=5)


@query("st1_windowed_entropy", f"WITH h AS (SELECT date_trunc('day', ts) AS window_start, user_id % 3 AS block_id, {sql_bin('value', 50, '0.0', '500.0')} AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT window_start, block_id, CAST(sum(n) AS BIGINT) AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM h GROUP BY ALL")
def st1(spark, d):
    e = table(spark, d, "events").select("ts", (F.col("user_id") % 3).alias("block_id"), "value")
    return rounded(windowed_entropy(e, 50, 0.0, 500.0), "entropy")


@query("io1_io2_raster_round_trip", f"WITH {CELLS} SELECT cell_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value FROM cells")
def io1(spark, d):
    from ..sources.raster import read_raster, write_raster

    df, g = event_grid(spark, d)
    path = shared_dir(spark, "raster") + "/field.vol"
    write_raster(df.select("cell_id", "value"), path, g.dims)
    back = read_raster(spark, path, blocks="2,2,4")
    return back.select("cell_id", "x", "y", "z", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("io6_io7_parallel_write", f"WITH {CELLS} SELECT cell_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, value FROM cells")
def io6(spark, d):
    """Slabs written and kept by the executors, read back by blocks that cross them."""
    from ..sources.raster import read_raster, write_raster

    df, g = event_grid(spark, d)
    path = shared_dir(spark, "raster") + "/field.slabs"
    write_raster(df.select("cell_id", "value"), path, g.dims, dtype="f8", slabs=True, cells_per_slab=-(-g.size // 7))
    return read_raster(spark, path, dtype="f8", blocks="2,2,3").select("cell_id", "x", "y", "z", "value")


@query("io5_raster_ghost_blocks", f"WITH {CELLS}, bb AS (SELECT ix, iy FROM (SELECT unnest(range(2)) AS ix), (SELECT unnest(range(2)) AS iy)) SELECT CAST(iy * 2 + ix AS INTEGER) AS block_id, count(*) AS n, CAST(sum((x // 5 <> ix OR y // 5 <> iy)::INT) AS BIGINT) AS ghosts FROM bb JOIN cells ON x BETWEEN ix * 5 - 1 AND ix * 5 + 5 AND y BETWEEN iy * 5 - 2 AND iy * 5 + 6 GROUP BY ix, iy")
def io5(spark, d):
    from ..sources.raster import read_raster, write_raster

    df, g = event_grid(spark, d)
    path = shared_dir(spark, "raster") + "/field.vol"
    write_raster(df.select("cell_id", "value"), path, g.dims, header=False, endian="big", dtype="f8")
    back = read_raster(spark, path, header="false", dims=",".join(map(str, g.dims)), endian="big", dtype="f8", blocks="2,2,1", ghost="1,2,0")
    return back.groupBy("block_id").agg(F.count("*").alias("n"), F.sum(F.col("is_ghost").cast("int")).alias("ghosts"))


_IO3 = "SELECT CAST((CASE WHEN z >= 2 * (zn // 3) THEN 2 ELSE z // (zn // 3) END * 3 + CASE WHEN y >= 6 THEN 2 ELSE y // 3 END) * 4 + CASE WHEN x >= 6 THEN 3 ELSE x // 2 END AS INTEGER) AS block_id, count(*) AS n, CAST(sum(cell_id) AS BIGINT) AS cells FROM cells, (SELECT max(z) + 1 AS zn FROM cells) GROUP BY 1"


@query("io3_raster_floor_split", f"WITH {CELLS} {_IO3}")
def io3(spark, d):
    """The floor split gives what is left of an axis to its last block."""
    from ..sources.raster import read_raster, write_raster

    df, g = event_grid(spark, d)
    path = shared_dir(spark, "raster") + "/field.vol"
    write_raster(df.select("cell_id", "value"), path, g.dims)
    return read_raster(spark, path, blocks="4,3,3", split="floor").groupBy("block_id").agg(F.count("*").alias("n"), F.sum("cell_id").alias("cells"))


@query("io14_endian", f"WITH {CELLS} SELECT o AS endian, t AS dtype, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM cells, (SELECT unnest(['little', 'big']) AS o), (SELECT unnest(['i4', 'i8']) AS t) GROUP BY ALL")
def io14(spark, d):
    from ..sources.raster import read_raster, write_raster

    df, g = event_grid(spark, d)
    root, out = shared_dir(spark, "raster"), None
    for order in ("little", "big"):
        for kind in ("i4", "i8"):
            path = f"{root}/{order}-{kind}.vol"
            write_raster(df.select("cell_id", F.floor("value").alias("value")), path, g.dims, dtype=kind, endian=order)
            one = read_raster(spark, path, endian=order, dtype=kind, blocks="1,1,2").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))
            one = one.select(F.lit(order).alias("endian"), F.lit(kind).alias("dtype"), "n", "total")
            out = one if out is None else out.unionByName(one)
    return out


@query("io24_patch_file", "SELECT CAST(i AS INTEGER) AS patch_id, i / 10.0 AS theta_lo, (i + 1) / 10.0 AS theta_hi, i / 20.0 AS phi_lo, (i + 1) / 20.0 AS phi_hi FROM (SELECT unnest(range(60)) AS i)")
def io24(spark, d):
    """A table of patches written as text, pairs of quoted lines, and read back."""
    from ..sources.files import filesystem
    from ..sources.tables import read_patches

    path = shared_dir(spark, "patches") + "/patches.txt"
    fs, p = filesystem(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as out:
        for i in range(60):
            out.write(f'"{i / 10},{(i + 1) / 10}"\n"{i / 20},{(i + 1) / 20}"\n\n'.encode())
    return read_patches(spark, path)


@query("io15_io16_step_tables", "SELECT CAST(day(ts) - 1 AS INTEGER) AS time_step, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def io16(spark, d):
    from ..operators.randomfield import Session
    from .fields import random_field

    with Session("run 1", shared_dir(spark, "session")) as s:
        f = random_field(spark, d)
        s.write_data(f)
        back = s.read(spark, "data")
    return back.groupBy("time_step").agg(F.count("*").alias("n"), F.round(F.sum("data_value"), 3).alias("total"))
