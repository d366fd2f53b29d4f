"""Queries over a tetrahedral mesh made from the whole event grid: every cube of eight cells is cut into six tetrahedra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tetmesh as T
from .common import CELLS, event_grid, query, rounded

#: Corners of the six tetrahedra of a cube along its diagonal, as numbers x + 2 y + 4 z.
KUHN = ((0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7))


def mesh(spark, d):
    """Vertices and cells of the whole grid; vid is the cell's id, cid counts six to the cube above its lowest corner."""
    df, g = event_grid(spark, d)
    return kuhn(df, g.dims)


def kuhn(part, dims):
    nx, ny, nz = dims
    vid = (F.col("z").cast("long") * ny + F.col("y")) * nx + F.col("x")
    v = part.select(vid.alias("vid"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("value").alias("f"))
    low = part.where((F.col("x") < nx - 1) & (F.col("y") < ny - 1) & (F.col("z") < nz - 1)).select(vid.alias("base"))
    corner = lambda k: F.col("base") + (k & 1) + nx * (k >> 1 & 1) + nx * ny * (k >> 2)
    tets = F.array(*[F.array(*[corner(k) for k in t]) for t in KUHN])
    c = low.select("base", F.posexplode(tets).alias("k", "v")).select((F.col("base") * 6 + F.col("k")).alias("cid"), "v")
    return v, c


_MESH = (
    f"{CELLS}, vert AS (SELECT CAST(cell_id AS BIGINT) AS vid, x, y, z, value AS f FROM cells), base AS (SELECT vid AS base FROM vert WHERE x < 9 AND y < 9 AND z < (SELECT max(z) FROM vert)), "
    "kuhn(k, i, c) AS (VALUES " + ", ".join(f"({k}, {i}, {(c & 1) + 10 * (c >> 1 & 1) + 100 * (c >> 2)})" for k, t in enumerate(KUHN) for i, c in enumerate(t)) + "), cell AS (SELECT base * 6 + k AS cid, i, base + c AS vid FROM base, kuhn)"
)


@query("io9_mesh_text", f"WITH {_MESH} SELECT vid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, f, (SELECT count(*) // 4 FROM cell) AS cells FROM vert")
def io9(spark, d):
    """The mesh as text, read back. Executors write the lines in order; the driver only passes their files on."""
    from ..sources.files import shared_dir
    from ..sources.tables import read_mesh, write_mesh

    v, c = mesh(spark, d)
    path = f"{shared_dir(spark, 'mesh')}/mesh.txt"
    write_mesh(v, c, path)
    v, c = read_mesh(spark, path)
    return v.join(F.broadcast(c.agg(F.count("*").alias("cells"))))


@query("t1_bounding_boxes", f"WITH {_MESH} SELECT cid, CAST(min(x) AS DOUBLE) AS lx, CAST(max(x) AS DOUBLE) AS hx, CAST(min(y) AS DOUBLE) AS ly, CAST(max(y) AS DOUBLE) AS hy, CAST(min(z) AS DOUBLE) AS lz, CAST(max(z) AS DOUBLE) AS hz FROM cell JOIN vert USING (vid) GROUP BY cid")
def t1(spark, d):
    return T.bounding_boxes(T.with_corners(*mesh(spark, d)))


@query("t4_box_relation", f"WITH {_MESH}, bb AS (SELECT cid, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM cell JOIN vert USING (vid) GROUP BY cid) SELECT vid, cid, (lx >= x - 1.2 AND hx <= x + 1.2 AND ly >= y - 1.2 AND hy <= y + 1.2 AND lz >= z - 1.2 AND hz <= z + 1.2) AS contained FROM vert, (SELECT unnest(range(-3, 3)) AS dx), (SELECT unnest(range(-3, 3)) AS dy), (SELECT unnest(range(-3, 3)) AS dz) JOIN bb ON lx = x + dx AND ly = y + dy AND lz = z + dz AND lx < x + 1.2 AND hx > x - 1.2 AND ly < y + 1.2 AND hy > y - 1.2 AND lz < z + 1.2 AND hz > z - 1.2")
def t4(spark, d):
    v, c = mesh(spark, d)
    return T.box_relation(v, T.bounding_boxes(T.with_corners(v, c)), 1.2)


@query("t5_face_neighbours", f"WITH {_MESH}, s AS (SELECT a.cid AS cid, b.cid AS other FROM cell a JOIN cell b ON a.vid = b.vid AND a.cid <> b.cid GROUP BY ALL HAVING count(*) = 3) SELECT cid, other FROM s")
def t5(spark, d):
    return T.face_neighbours(mesh(spark, d)[1]).select("cid", "other")


@query("t5_vertex_cells", f"WITH {_MESH} SELECT vid, cid FROM cell")
def t5_vertex(spark, d):
    return T.vertex_cells(mesh(spark, d)[1])


@query("t6_sorted_values", f"WITH {_MESH} SELECT cid, f[1] AS f0, f[2] AS f1, f[3] AS f2, f[4] AS f3 FROM (SELECT cid, list_sort(list(f)) AS f FROM cell JOIN vert USING (vid) GROUP BY cid)")
def t6(spark, d):
    return T.with_corners(*mesh(spark, d)).withColumn("s", T.ordered(F.col("corners"))).select("cid", *[F.col("s")[i]["f"].alias(f"f{i}") for i in range(4)])


@query("t7_cross_sections")
def t7(spark, d):
    m = T.with_corners(*mesh(spark, d)).withColumn("s", T.ordered(F.col("corners")))
    return rounded(m.select("cid", T.cross_section(F.col("s"), 1).alias("at_second"), T.cross_section(F.col("s"), 2).alias("at_third")), "at_second", "at_third")


@query("t8_t9_volume_histogram_total", f"WITH {_MESH} SELECT round(count(DISTINCT cid) / 6.0, 6) AS total FROM cell")
def t9(spark, d):
    return rounded(T.global_histogram(*mesh(spark, d), 40, "volume").agg(F.sum("n").alias("total")), "total")


@query("e11_mesh_entropy_volume")
def e11_volume(spark, d):
    return rounded(T.global_entropy(*mesh(spark, d), 40, "volume"), "entropy")


@query("e11_mesh_entropy_area")
def e11_area(spark, d):
    return rounded(T.global_entropy(*mesh(spark, d), 40, "area", normalize=True), "entropy")


@query("e12_mesh_local_entropy")
def e12(spark, d):
    return rounded(T.local_entropy(*mesh(spark, d), 1.2, 16), "entropy")
