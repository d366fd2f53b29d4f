"""Queries over binning, histograms, entropies, blocks and random fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import blocks as K
from ..operators import entropy as E
from ..operators import sphere, stencil
from ..operators.grid import Field
from ..operators.randomfield import RandomField
from .common import CELLS, VECS, event_grid, query, rounded, sql_bin, sql_entropy, table, vectors

PRICE = f"r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT l_orderkey, {sql_bin('l_extendedprice', 100)} AS bin FROM lineitem, r), h AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)"
VALUE = f"r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT cells.*, {sql_bin('value', 25)} AS bin FROM cells, r)"


def price_bins(spark, d, n=100):
    return B.with_bin(table(spark, d, "lineitem").select("l_extendedprice"), n, "l_extendedprice")


def event_bins(spark, d, n=25):
    df, g = event_grid(spark, d)
    return B.with_bin(df, n), g


# ---------------------------------------------------------------- bins


@query("bin1_scalar", f"WITH {CELLS}, {VALUE} SELECT cell_id, bin FROM b")
def bin1(spark, d):
    return event_bins(spark, d)[0].select("cell_id", "bin")


@query("bin2_non_spatial", f"WITH {PRICE} SELECT bin, n FROM h")
def bin2(spark, d):
    return E.counts(price_bins(spark, d))


@query("bin3_given_range", f"SELECT event_id, {sql_bin('value', 64, '100.0', '300.0')} AS bin FROM events")
def bin3(spark, d):
    return B.with_bin(table(spark, d, "events"), 64, "value", (100.0, 300.0)).select("event_id", "bin")


def sql_patches(n: int) -> str:
    return "p(id, a, b, c, d) AS (VALUES " + ", ".join(f"({i}, {a!r}, {b!r}, {c!r}, {e!r})" for i, (a, b, c, e) in enumerate(sphere.equal_area_patches(n).tolist())) + ")"


_CORNER = "t AS (SELECT vec_id, 2 * pi() * least({nt} - 1, floor({nt} * (CASE WHEN u = 0 AND v = 0 THEN 0 ELSE pi() + atan2(v, u) END) / (2 * pi()))) / {nt} AS th, pi() * least({np} - 1, floor({np} * abs(pi() / 2 - atan2(w, sqrt(u*u + v*v))) / pi())) / {np} AS ph FROM vecs)"
_FIRST = "SELECT vec_id, CAST(min(id) AS INTEGER) AS bin FROM t JOIN p ON ph BETWEEN c AND d AND (th BETWEEN a AND b OR th + 2 * pi() BETWEEN a AND b) GROUP BY vec_id"


@query("bin4_sphere_patch", f"WITH {VECS}, {sql_patches(360)}, {_CORNER.format(nt=720, np=360)} {_FIRST}")
def bin4(spark, d):
    return vectors(spark, d).select("vec_id", sphere.patch_bin(F.col("u"), F.col("v"), F.col("w")).alias("bin"))


@query("bin5_sphere_patch_in_situ", f"WITH {VECS}, {sql_patches(360)}, {_CORNER.format(nt=512, np=256)} {_FIRST}")
def bin5(spark, d):
    return vectors(spark, d).select("vec_id", sphere.patch_bin(F.col("u"), F.col("v"), F.col("w"), 360, 512, 256).alias("bin"))


_CENTRE = "m AS (SELECT id, (a + b) / 2 AS th, CASE WHEN id = 0 THEN 0 WHEN id = 359 THEN pi() ELSE (c + d) / 2 END AS ph FROM p), q AS (SELECT id, round(sin(ph) * cos(th), 6) AS cx, round(sin(ph) * sin(th), 6) AS cy, round(cos(ph), 6) AS cz FROM m)"


@query("bin6_patches", f"WITH {sql_patches(360)}, {_CENTRE} SELECT CAST(id AS INTEGER) AS patch_id, round(a, 6) AS theta_lo, round(b, 6) AS theta_hi, round(c, 6) AS phi_lo, round(d, 6) AS phi_hi, cx, cy, cz FROM p JOIN q USING (id)")
def bin6(spark, d):
    return rounded(sphere.patches(spark, 360), "theta_lo", "theta_hi", "phi_lo", "phi_hi", "cx", "cy", "cz")


@query("bin7_plane_angle", f"WITH {VECS} SELECT vec_id, CAST(least(greatest(floor((CASE WHEN u = 0 AND v = 0 THEN 0 ELSE pi() + atan2(v, u) END) / (2 * pi()) * 90), 0), 89) AS INTEGER) AS bin FROM vecs")
def bin7(spark, d):
    return vectors(spark, d).select("vec_id", B.angle_bin(F.col("u"), F.col("v"), 90).alias("bin"))


@query("bin8_geodesic")
def bin8(spark, d):
    return vectors(spark, d).select("vec_id", sphere.geodesic_bin(F.col("u"), F.col("v"), F.col("w"), 4).alias("bin"))


def sql_ray(divisions: int) -> str:
    """Triangle of each vector by barycentric coordinates of the ray's hit; the first triangle counts, none gives null."""
    v, tri = sphere.geodesic(divisions)
    names = [f"{p}_{c}" for p in "abc" for c in "xyz"]
    rows = ", ".join(f"({i}, {', '.join(f'{x!r}::DOUBLE' for x in v[t].ravel().tolist())})" for i, t in enumerate(tri))
    cross = lambda p, q: [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]
    dot = lambda p, q: "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q)) + ")"
    e1, e2, a, d = [f"(b_{c} - a_{c})" for c in "xyz"], [f"(c_{c} - a_{c})" for c in "xyz"], [f"(-a_{c})" for c in "xyz"], ["u", "v", "w"]
    h, q = cross(d, e2), cross(a, e1)
    each = f"SELECT vec_id, tri_id, {dot(e1, h)} AS det, {dot(a, h)} AS bary1, {dot(d, q)} AS bary2, {dot(e2, q)} AS far FROM vecs, tri"
    hit = "abs(det) > 1e-12 AND bary1 / det >= -1e-9 AND bary2 / det >= -1e-9 AND bary1 / det + bary2 / det <= 1 + 1e-9 AND far / det > 0"
    return f"tri(tri_id, {', '.join(names)}) AS (VALUES {rows}), hits AS ({each}) SELECT vec_id, CAST(min(tri_id) FILTER (WHERE {hit}) AS INTEGER) AS bin FROM hits GROUP BY vec_id"


@query("bin8_geodesic_exact", f"WITH {VECS}, {sql_ray(3)}")
def bin8_exact(spark, d):
    return sphere.geodesic_exact(vectors(spark, d), "u", "v", "w", 3, "vec_id")


@query("bin9_geodesic_hierarchy", "WITH l AS (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS level) SELECT level, CAST(20 * 4 ** (level - 1) AS BIGINT) AS triangles, CAST(CASE WHEN level > 1 THEN 20 * 4 ** (level - 2) ELSE 0 END AS BIGINT) AS parents FROM l")
def bin9(spark, d):
    return sphere.triangles(spark, 4).groupBy("level").agg(F.count("*").alias("triangles"), F.count_distinct("parent_id").alias("parents"))


_DEC = ", ".join(f"r{c} AS (SELECT min({c}) AS lo, max({c}) AS hi FROM vecs)" for c in "uvw")


@query("bin10_components", f"WITH {VECS}, {_DEC} SELECT vec_id, " + ", ".join(f"{sql_bin(c, 16, f'r{c}.lo', f'r{c}.hi')} AS bin_{c}" for c in "uvw") + " FROM vecs, ru, rv, rw")
def bin10(spark, d):
    return B.with_component_bins(vectors(spark, d), 16, ["u", "v", "w"]).select("vec_id", "bin_u", "bin_v", "bin_w")


JOINT = f"q AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), p AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT {sql_bin('l_extendedprice', 32, 'p.lo', 'p.hi')} * 32 + {sql_bin('l_quantity', 32, 'q.lo', 'q.hi')} AS bin FROM lineitem, p, q), h AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)"


def joint_bins(spark, d):
    return B.with_joint_bin(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), 32, "l_quantity", "l_extendedprice")


@query("bin11_joint_scalar", f"WITH {JOINT} SELECT bin, n FROM h")
def bin11(spark, d):
    return E.counts(joint_bins(spark, d))


@query("bin12_joint_vector", f"WITH {VECS}, {sql_patches(24)}, {_CORNER.format(nt=48, np=24)}, t2 AS (SELECT vec_id, 2 * pi() * least(47, floor(48 * (pi() + atan2(t, s)) / (2 * pi()))) / 48 AS th, pi() * least(23, floor(24 * abs(pi() / 2 - atan2(r, sqrt(s*s + t*t))) / pi())) / 24 AS ph FROM vecs), b1 AS ({_FIRST}), b2 AS ({_FIRST.replace('FROM t JOIN', 'FROM t2 JOIN')}) SELECT vec_id, CAST(b2.bin * 24 + b1.bin AS INTEGER) AS bin FROM b1 JOIN b2 USING (vec_id)")
def bin12(spark, d):
    one, two = sphere.patch_bin(F.col("u"), F.col("v"), F.col("w"), 24), sphere.patch_bin(F.col("s"), F.col("t"), F.col("r"), 24)
    return vectors(spark, d).select("vec_id", (two * 24 + one).alias("bin"))


@query("bin13_patch_centre", f"WITH {VECS}, {sql_patches(360)}, {_CORNER.format(nt=720, np=360)}, {_CENTRE}, f AS ({_FIRST}) SELECT vec_id, cx, cy, cz FROM f JOIN q ON q.id = f.bin")
def bin13(spark, d):
    b = vectors(spark, d).select("vec_id", sphere.patch_bin(F.col("u"), F.col("v"), F.col("w")).alias("patch_id"))
    return rounded(b.join(F.broadcast(sphere.patches(spark, 360)), "patch_id").select("vec_id", "cx", "cy", "cz"), "cx", "cy", "cz")


@query("bin14_default_bins", f"WITH k AS (SELECT greatest(1, count(*) // 10) AS n FROM events), r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT {sql_bin('value', 'k.n')} AS bin FROM events, r, k) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def bin14(spark, d):
    e = table(spark, d, "events")
    return E.counts(B.with_bin(e.select("value"), B.default_bins(e.count())))


@query("bin16_multi_resolution", f"WITH {VECS}, " + ", ".join(f"p{n} AS ({sql_patches(n)[sql_patches(n).index('(VALUES') :].join(['SELECT * FROM ', ' v(id, a, b, c, d)'])})" for n in (12, 48)) + ", " + ", ".join(_CORNER.format(nt=2 * n, np=n).replace("t AS (", f"t{n} AS (", 1) for n in (12, 48)) + ", " + ", ".join(f"b{n} AS ({_FIRST.replace('FROM t JOIN p', f'FROM t{n} JOIN p{n}')})" for n in (12, 48)) + " SELECT vec_id, b12.bin AS bin_12, b48.bin AS bin_48 FROM b12 JOIN b48 USING (vec_id)")
def bin16(spark, d):
    return vectors(spark, d).select("vec_id", *[sphere.patch_bin(F.col("u"), F.col("v"), F.col("w"), n).alias(f"bin_{n}") for n in (12, 48)])


# ---------------------------------------------------------------- counts


@query("ag1_frequencies", f"WITH {PRICE} SELECT bin, n, round(n / sum(n) OVER (), 9) AS p FROM h")
def ag1(spark, d):
    return rounded(E.normalized(E.counts(price_bins(spark, d))), "p", digits=9)


@query("ag2_merged_histograms", f"WITH r AS (SELECT 0.0 AS lo, 100000.0 AS hi) SELECT bin, count(*) AS n FROM (SELECT {sql_bin('l_extendedprice', 50)} AS bin FROM lineitem, r) GROUP BY bin")
def ag2(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice", "l_linestatus")
    one = lambda s: E.counts(B.with_bin(li.where(F.col("l_linestatus") == s), 50, "l_extendedprice", (0.0, 100000.0)))
    other = E.counts(B.with_bin(li.where(~F.col("l_linestatus").isin("O", "F")), 50, "l_extendedprice", (0.0, 100000.0)))
    return E.merge_counts([one("O"), one("F"), other])


@query("ag4_dense_histogram", f"SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n FROM (SELECT unnest(range(200)) AS bin) g LEFT JOIN (SELECT {sql_bin('value', 200, '-100.0', '900.0')} AS bin, count(*) AS n FROM events GROUP BY 1) h USING (bin)")
def ag4(spark, d):
    return E.dense(E.counts(B.with_bin(table(spark, d, "events").select("value"), 200, "value", (-100.0, 900.0))), 200)


@query("ag6_statistics", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 2) AS variance, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY l_returnflag")
def ag6(spark, d):
    s = E.statistics(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("std", 4).alias("std"))


@query("ag7_histogram_statistics", f"WITH {PRICE} SELECT round(sum(n * (bin + 0.5)) / sum(n), 6) AS mean, round(sum(n * (bin + 0.5) ** 2) / sum(n) - (sum(n * (bin + 0.5)) / sum(n)) ** 2, 6) AS variance FROM h")
def ag7(spark, d):
    return rounded(E.histogram_statistics(E.counts(price_bins(spark, d)), F.col("bin") + 0.5), "mean", "variance")


@query("ag11_block_range", "SELECT user_id, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum FROM events GROUP BY user_id")
def ag11(spark, d):
    return rounded(E.array_statistics(table(spark, d, "events"), "value", ["user_id"]), "sum", digits=4)


@query("ag12_block_extents", f"WITH {CELLS} SELECT CAST(max(x) + 1 AS INTEGER) AS nx, CAST(max(y) + 1 AS INTEGER) AS ny, CAST(max(z) + 1 AS INTEGER) AS nz, max(cell_id) AS last FROM cells")
def ag12(spark, d):
    df, _ = event_grid(spark, d)
    return df.agg(*[(F.max(c) + 1).cast("int").alias(f"n{c}") for c in "xyz"], F.max("cell_id").alias("last"))


@query("ag3_counts_of_range", f"SELECT bin, count(*) AS n FROM (SELECT {sql_bin('value', 40, '50.0', '250.0')} AS bin FROM events WHERE value BETWEEN 50 AND 250) GROUP BY bin")
def ag3(spark, d):
    return E.counts(B.with_bin(table(spark, d, "events").where(F.col("value").between(50, 250)).select("value"), 40, "value", (50.0, 250.0)))


@query("ag5_joint_counts", f"WITH q AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), p AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT {sql_bin('l_quantity', 12, 'q.lo', 'q.hi')} AS b1, {sql_bin('l_extendedprice', 12, 'p.lo', 'p.hi')} AS b2, count(*) AS n FROM lineitem, p, q GROUP BY 1, 2")
def ag5(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    both = B.with_bin(B.with_bin(li, 12, "l_quantity", out="b1"), 12, "l_extendedprice", out="b2")
    return E.counts(both, ["b1"], "b2")


@query("ag10_merged_blocks", f"WITH {CELLS}, {VALUE} SELECT bin, count(*) AS n FROM b GROUP BY bin")
def ag10(spark, d):
    """Histograms of single blocks, merged: the same as that of the whole field."""
    b, g = event_bins(spark, d)
    per = E.counts(K.with_block(b, g, (2, 2, 2)), ["block_id"])
    return E.merge_counts([per.where(F.col("block_id") % 2 == k).drop("block_id") for k in (0, 1)])


# ---------------------------------------------------------------- entropies


@query("e1_entropy_of_counts", f"WITH {PRICE} {sql_entropy('h', norm=100)}")
def e1(spark, d):
    return rounded(E.from_counts(E.counts(price_bins(spark, d)), n_bins=100), "entropy")


@query("e2_entropy_of_probabilities", f"WITH {PRICE}, p AS (SELECT n / sum(n) OVER () AS p FROM h) SELECT round(-sum(p * log2(p)), 6) AS entropy FROM p")
def e2(spark, d):
    return rounded(E.from_probabilities(E.normalized(E.counts(price_bins(spark, d)))), "entropy")


@query("e3_entropy_of_bin_array", "WITH b AS (SELECT user_id, CAST(floor(value / 10) AS INTEGER) AS bin FROM events), h AS (SELECT user_id, bin, count(*) AS n FROM b GROUP BY ALL) " + sql_entropy("h", "user_id"))
def e3(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.floor(F.col("value") / 10).cast("int")).alias("bins"))
    return rounded(lists.select("user_id", E.of_bin_array(F.col("bins")).alias("entropy")), "entropy")


@query("e4_weighted_entropy", f"WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), h AS (SELECT {sql_bin('l_extendedprice', 100)} AS bin, sum(l_quantity) AS n FROM lineitem, r GROUP BY 1) {sql_entropy('h')}")
def e4(spark, d):
    b = B.with_bin(table(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), 100, "l_extendedprice")
    return rounded(E.from_counts(b.groupBy("bin").agg(F.sum("l_quantity").alias("n"))), "entropy")


@query("e6_global_entropy", f"WITH {PRICE} {sql_entropy('h')}")
def e6(spark, d):
    return rounded(E.of_bins(price_bins(spark, d)), "entropy")


@query("e6_global_entropy_vector", f"WITH {VECS}, {sql_patches(360)}, {_CORNER.format(nt=720, np=360)}, b AS ({_FIRST}), h AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) {sql_entropy('h', norm=360)}")
def e6_vector(spark, d):
    return rounded(E.of_bins(vectors(spark, d).select(sphere.patch_bin(F.col("u"), F.col("v"), F.col("w")).alias("bin")), n_bins=360), "entropy")


_BLOCK = "block AS (SELECT *, CAST((z // 5) * 4 + (y // 5) * 2 + x // 5 AS INTEGER) AS block_id FROM cells)"


@query("e7_blockwise_entropy", f"WITH {CELLS}, {_BLOCK}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM cells), h AS (SELECT block_id, {sql_bin('value', 25)} AS bin, count(*) AS n FROM block, r GROUP BY ALL) {sql_entropy('h', 'block_id')}")
def e7(spark, d):
    b, g = event_bins(spark, d)
    b = K.with_block(b, g, (2, 2, -(-g.dims[2] // 5)))
    return rounded(E.of_bins(b, ["block_id"]), "entropy")


@query("e7_blockwise_own_range", f"WITH {CELLS}, {_BLOCK}, r AS (SELECT block_id, min(value) AS lo, max(value) AS hi FROM block GROUP BY block_id), h AS (SELECT block_id, {sql_bin('value', 25)} AS bin, count(*) AS n FROM block JOIN r USING (block_id) GROUP BY ALL) {sql_entropy('h', 'block_id')}")
def e7_own(spark, d):
    df, g = event_grid(spark, d)
    b = K.with_block(df, g, (2, 2, -(-g.dims[2] // 5)))
    return rounded(E.of_bins(B.with_bin(b, 25, range_="block", keys=["block_id"]), ["block_id"]), "entropy")


def sql_local(b: str, key: str = "bin", zmax: str = "(SELECT max(z) FROM cells)", radius: tuple[int, int, int] = (1, 1, 1), norm: int | None = None) -> str:
    m = lambda v, h: f"(CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} > {h} THEN 2 * {h} - ({v}) - 1 ELSE {v} END)"
    reach = ", ".join(f"(SELECT unnest(range({-k}, {k + 1})) AS d) {n}" for n, k in zip("abc", radius))
    return f"o AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM {reach}), s AS (SELECT cell_id, {m('x + dx', '9')} AS nx, {m('y + dy', '9')} AS ny, {m('z + dz', zmax)} AS nz FROM cells, o), h AS (SELECT s.cell_id, {key} AS bin, count(*) AS n FROM s JOIN {b} ON {b}.x = nx AND {b}.y = ny AND {b}.z = nz GROUP BY ALL) {sql_entropy('h', 'cell_id', norm=norm)}"


@query("e8_local_entropy", f"WITH {CELLS}, {VALUE}, {sql_local('b')}")
def e8(spark, d):
    b, g = event_bins(spark, d)
    return rounded(stencil.local_entropy(b, g, 1, 25).select("cell_id", "entropy"), "entropy")


@query("e8_local_entropy_wide", f"WITH {CELLS}, {VALUE}, {sql_local('b', radius=(3, 3, 6), norm=25)}")
def e8_wide(spark, d):
    b, g = event_bins(spark, d)
    return rounded(stencil.local_entropy(b, g, (3, 3, 6), 25, normalize=True).select("cell_id", "entropy"), "entropy")


@query("e9_global_joint_entropy", f"WITH {JOINT} {sql_entropy('h')}")
def e9(spark, d):
    return rounded(E.of_bins(joint_bins(spark, d)), "entropy")


_TWO = f"r AS (SELECT min(value) AS lo, max(value) AS hi FROM cells), b AS (SELECT x, y, z, {sql_bin('value', 8)} AS b1, CAST(user_id % 8 AS INTEGER) AS b2 FROM cells, r)"


@query("e10_local_joint_entropy", f"WITH {CELLS}, {_TWO}, {sql_local('b', 'b2 * 8 + b1')}")
def e10(spark, d):
    df, g = event_grid(spark, d)
    b = B.with_bin(df, 8).withColumn("bin", ((F.col("user_id") % 8) * 8 + F.col("bin")).cast("int"))
    return rounded(stencil.local_entropy(b, g, 1, 64).select("cell_id", "entropy"), "entropy")


# ---------------------------------------------------------------- blocks and joins


@query("j1_joint_fields", f"WITH {CELLS}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM cells), o AS (SELECT o_orderkey AS cell_id, o_totalprice AS v2 FROM orders), q AS (SELECT min(v2) AS lo, max(v2) AS hi FROM cells JOIN o USING (cell_id)), q1 AS (SELECT min(value) AS lo, max(value) AS hi FROM cells JOIN o USING (cell_id)), h AS (SELECT {sql_bin('v2', 16, 'q.lo', 'q.hi')} * 16 + {sql_bin('value', 16, 'q1.lo', 'q1.hi')} AS bin, count(*) AS n FROM cells JOIN o USING (cell_id), q, q1 GROUP BY 1) {sql_entropy('h')}")
def j1(spark, d):
    df, _ = event_grid(spark, d)
    other = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_totalprice").alias("value"))
    return rounded(E.of_bins(B.with_joint_bin(B.joint_fields(df, other), 16, "value1", "value2")), "entropy")


@query("r1_sub_box", f"WITH {CELLS} SELECT cell_id, value FROM cells WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 8 AND z BETWEEN 3 AND 7")
def r1(spark, d):
    df, g = event_grid(spark, d)
    return Field(df, g).between((2.4, 1.0, 3.9), (5.2, 8.0, 7.0)).df.select("cell_id", "value")


@query("r2_point_access", f"WITH {CELLS} SELECT cell_id, CASE WHEN cell_id = 123 THEN -1.0 ELSE value END AS value FROM cells WHERE cell_id IN (123, 456)")
def r2(spark, d):
    df, g = event_grid(spark, d)
    f = Field(df.select("cell_id", "x", "y", "z", "value"), g).with_value(123, -1.0)
    return f.at(123).unionByName(f.at_point(6, 5, 4)).select("cell_id", "value")


@query("r3_shared_partition", f"WITH {CELLS}, s AS (SELECT 5 AS sx, 5 AS sy, CAST(ceil(max(z) / 4.0) AS INTEGER) AS sz FROM cells), k AS (SELECT unnest(range(16)) AS block_id), bb AS (SELECT block_id, (block_id % 2) * sx AS x0, ((block_id // 2) % 2) * sy AS y0, (block_id // 4) * sz AS z0, sx, sy, sz FROM k, s) SELECT CAST(block_id AS INTEGER) AS block_id, count(*) AS n, round(sum(value), 4) AS total FROM bb JOIN cells ON x BETWEEN x0 AND x0 + sx AND y BETWEEN y0 AND y0 + sy AND z BETWEEN z0 AND z0 + sz GROUP BY block_id")
def r3(spark, d):
    df, g = event_grid(spark, d)
    return rounded(K.shared_blocks(df, g, (2, 2, 4)).groupBy("block_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("r4_blocks", f"WITH {CELLS}, {_BLOCK} SELECT block_id, count(*) AS n, round(sum(value), 4) AS total FROM block GROUP BY block_id")
def r4(spark, d):
    df, g = event_grid(spark, d)
    b = K.with_block(df, g, (2, 2, -(-g.dims[2] // 5)))
    return rounded(b.groupBy("block_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("j6_ghost_cells", f"WITH {CELLS}, bb AS (SELECT ix, iy, iz FROM (SELECT unnest(range(2)) AS ix) a, (SELECT unnest(range(2)) AS iy) b, (SELECT unnest(range((SELECT max(z) // 5 + 1 FROM cells))) AS iz) c) SELECT CAST(iz * 4 + iy * 2 + ix AS INTEGER) AS block_id, count(*) AS n, CAST(sum((x // 5 <> ix OR y // 5 <> iy OR z // 5 <> iz)::INT) AS BIGINT) AS ghosts FROM bb JOIN cells ON x BETWEEN ix * 5 - 1 AND ix * 5 + 5 AND y BETWEEN iy * 5 - 1 AND iy * 5 + 5 AND z BETWEEN iz * 5 - 1 AND iz * 5 + 5 GROUP BY ix, iy, iz")
def j6(spark, d):
    df, g = event_grid(spark, d)
    b = K.ghost_blocks(df, g, (2, 2, -(-g.dims[2] // 5)), 1)
    return b.groupBy("block_id").agg(F.count("*").alias("n"), F.sum(F.col("is_ghost").cast("int")).alias("ghosts"))


@query("j11_global_ids", "SELECT user_id * 2 + 1 AS block_id, count(*) AS n FROM events GROUP BY user_id")
def j11(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("block_id"), "value")
    m = e.select("block_id").distinct().select("block_id", (F.col("block_id") * 2 + 1).alias("global_id"))
    return K.with_global_ids(e, m).groupBy("block_id").agg(F.count("*").alias("n"))


@query("io22_block_report", f"WITH {CELLS}, {_BLOCK}, r AS (SELECT min(value) AS lo, max(value) AS hi FROM cells), c AS (SELECT block.*, {sql_bin('value', 25)} AS bin FROM block, r), h AS (SELECT block_id, bin, count(*) AS n FROM c GROUP BY ALL), e AS ({sql_entropy('h', 'block_id')}) SELECT block_id, CAST(min(x) AS INTEGER) AS x_lo, CAST(max(x) AS INTEGER) AS x_hi, CAST(min(z) AS INTEGER) AS z_lo, CAST(max(z) AS INTEGER) AS z_hi, entropy, round(sum((bin = 3)::INT) / count(*), 6) AS share_3 FROM c JOIN e USING (block_id) GROUP BY block_id, entropy")
def io22(spark, d):
    b, g = event_bins(spark, d)
    b = K.with_block(b, g, (2, 2, -(-g.dims[2] // 5)))
    return rounded(K.block_report(b, 25).select("block_id", "x_lo", "x_hi", "z_lo", "z_hi", "entropy", F.col("freq")[3].alias("share_3")), "entropy", "share_3")


# ---------------------------------------------------------------- random fields


def random_field(spark, d) -> RandomField:
    e = table(spark, d, "events")
    df = e.select((F.dayofmonth("ts") - 1).alias("time_step"), (F.col("user_id") % 4).cast("int").alias("block_id"), *[F.lit(0).alias(c) for c in "xyz"], "value", (F.col("event_id") % 17 - 8).cast("double").alias("other"))
    f = RandomField(df).component("value", lo=0.0, hi=400.0).component("other")
    return f.as_scalar("v", "value", lo=0.0, hi=400.0, n_bins=40).as_vector2("angle", ["value", "other"], n_bins=36).random_variable("size", ["value", "other"], "abs", 0.0, 500.0, 50)


_RF = "f AS (SELECT CAST(day(ts) - 1 AS INTEGER) AS time_step, CAST(user_id % 4 AS INTEGER) AS block_id, least(greatest(value, 0.0), 400.0) AS value, CAST(event_id % 17 - 8 AS DOUBLE) AS other FROM events)"
_V = "CAST(least(floor(least(greatest(value / 400.0 * 40, 0), 40)), 39) AS INTEGER)"
_A = "CAST(least(floor(least(greatest((atan2(other, value) + pi()) / (2 * pi()) * 36, 0), 36)), 35) AS INTEGER)"


@query("e13_block_entropy", f"WITH {_RF}, h AS (SELECT time_step, block_id, {_V} AS bin, count(*) AS n FROM f GROUP BY ALL) SELECT *, 'v' AS rv FROM ({sql_entropy('h', 'time_step, block_id')})")
def e13(spark, d):
    return rounded(random_field(spark, d).entropy("v"), "entropy")


@query("e13_block_joint_entropy", f"WITH {_RF}, h AS (SELECT time_step, block_id, {_A} * 40 + {_V} AS bin, count(*) AS n FROM f GROUP BY ALL) SELECT *, 'v,angle' AS rv FROM ({sql_entropy('h', 'time_step, block_id')})")
def e13_joint(spark, d):
    return rounded(random_field(spark, d).joint_entropy("v", "angle"), "entropy")


@query("a12_samples", f"WITH {_RF} SELECT time_step, block_id, count(*) AS n, round(sum(sqrt(value * value + other * other)), 3) AS total, round(sum(least(greatest(sqrt(value * value + other * other) / 500 * 50, 0), 50)), 3) AS coordinates FROM f GROUP BY ALL")
def a12(spark, d):
    s = random_field(spark, d).samples("size")
    return rounded(s.groupBy("time_step", "block_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum("coordinate").alias("coordinates")), "total", "coordinates", digits=3)


@query("a8_domain_range", f"WITH {_RF}, r AS (SELECT min(other) AS lo, max(other) AS hi FROM f), h AS (SELECT time_step, block_id, CAST(least(floor(least(greatest((other - lo) / (hi - lo) * 20, 0), 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM f, r GROUP BY ALL) SELECT *, 'o' AS rv FROM ({sql_entropy('h', 'time_step, block_id')})")
def a8(spark, d):
    f = random_field(spark, d).as_scalar("o", "other", n_bins=20).use_domain_range("o")
    return rounded(f.entropy("o"), "entropy")


@query("io20_feature_vectors", f"WITH {_RF} SELECT time_step, count(*) AS n, round(sum(value), 3) AS a, round(sum(other), 3) AS b, 0.0::DOUBLE AS c FROM f GROUP BY time_step")
def io20(spark, d):
    v = random_field(spark, d).feature_vectors("angle")
    return v.groupBy("time_step").agg(F.count("*").alias("n"), *[F.round(F.sum(F.col("value")[i]), 3).alias(k) for i, k in enumerate("abc")])


@query("io19_geometry", "SELECT CAST(0 AS INTEGER) AS time_step, CAST(p_size AS INTEGER) AS block_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS i, CAST(p_partkey AS DOUBLE) AS coord, CAST(lead(p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) - p_partkey AS DOUBLE) AS delta FROM part")
def io19(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part")
    c = p.select(F.lit(0).alias("time_step"), F.col("p_size").alias("block_id"), (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1).alias("i"), F.col("p_partkey").cast("double").alias("coord"))
    return RandomField(c).rectangular_coordinates(0, c).geometry().drop("dim")


@query("io21_entropy_log", f"WITH {_RF}, h AS (SELECT block_id, {_V} AS bin, count(*) AS n FROM f GROUP BY ALL), e AS ({sql_entropy('h', 'block_id')}) SELECT block_id, CAST(0 AS INTEGER) AS rv, round(entropy, 4) AS entropy FROM e")
def io21(spark, d):
    from ..sources.tables import format_entropy_log, parse_entropy_log

    f = random_field(spark, d)
    one = E.of_bins(f.bins("v"), ["block_id"]).withColumn("rv", F.lit(0))
    return parse_entropy_log(format_entropy_log(one)).withColumn("entropy", F.round("entropy", 4))
