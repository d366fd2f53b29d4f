"""Queries over element-wise functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vector as V
from .common import CELLS, VECS, event_grid, query, rounded, table, vectors


@query("s1_clamp", "SELECT event_id, least(greatest(value, 50.0), 200.0) AS v FROM events")
def s1(spark, d):
    return table(spark, d, "events").select("event_id", S.clamp(F.col("value"), 50.0, 200.0).alias("v"))


_B = "SELECT event_id, CAST(CASE WHEN i < 0 THEN -i - 1 WHEN i > 9 THEN {high} ELSE i END AS INTEGER) AS i FROM (SELECT event_id, event_id % 14 - 2 AS i FROM events)"


@query("s2_mirror_index", _B.format(high="2 * 9 - i - 1"))
def s2(spark, d):
    return table(spark, d, "events").select("event_id", S.boundary(F.col("event_id") % 14 - 2, 10).cast("int").alias("i"))


@query("s3_clamp_index", "SELECT event_id, CAST(least(greatest(event_id % 14 - 2, 0), 9) AS INTEGER) AS i FROM events")
def s3(spark, d):
    return table(spark, d, "events").select("event_id", S.boundary(F.col("event_id") % 14 - 2, 10, "clamp").cast("int").alias("i"))


@query("s4_array_aggregates", "SELECT vec_id, round(list_min(e), 6) AS lo, round(list_max(e), 6) AS hi, round(list_sum(e), 5) AS total, round(list_product(e[1:3]) * 1000, 6) AS product FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def s4(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(F.array_min("e"), 6).alias("lo"), F.round(F.array_max("e"), 6).alias("hi"), F.round(S.array_sum(F.col("e")), 5).alias("total"), F.round(S.array_product(F.slice("e", 1, 3)) * 1000, 6).alias("product"))


@query(
    "s5_array_arithmetic",
    "SELECT vec_id, round(list_sum(list_transform(e, lambda x: ((x + 1.5) * 2 - 0.5) / 4)), 5) AS scaled, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] + e[len(e) + 1 - i])), 5) AS added, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - e[len(e) + 1 - i]))), 5) AS gap, CAST(len(e) * 3.0 AS DOUBLE) AS filled FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def s5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, back = F.col("e"), F.reverse("e")
    scaled = S.array_divide(S.array_divide(S.array_add_scalar(S.array_scale(S.array_add_scalar(a, 1.5), 2.0), -0.5), 4.0), 0.0)
    out = {"scaled": S.array_sum(scaled), "added": S.array_sum(S.array_add(a, back)), "gap": S.array_sum(F.transform(S.array_subtract(a, back), F.abs))}
    return e.select("vec_id", *[F.round(c, 5).alias(k) for k, c in out.items()], S.array_sum(S.array_fill(a, 3.0)).alias("filled"))


_L = "{a} * {f} + {b} * (1 - {f})"


@query(
    "s6_interpolation",
    f"WITH {VECS} SELECT vec_id, round(u * 0.25 + v * 0.75, 6) AS lin, round((u * 0.25 + v * 0.75) * 0.6 + (w * 0.25 + s * 0.75) * 0.4, 6) AS bil, round(((u * 0.25 + v * 0.75) * 0.6 + (w * 0.25 + s * 0.75) * 0.4) * 0.1 + ((t * 0.25 + r * 0.75) * 0.6 + (u * 0.25 + w * 0.75) * 0.4) * 0.9, 6) AS tri FROM vecs",
)
def s6(spark, d):
    df, c = vectors(spark, d), [F.col(n) for n in "uvwstruw"]
    return rounded(df.select("vec_id", S.lerp(c[0], c[1], 0.25).alias("lin"), S.bilerp(c[:4], 0.25, 0.6).alias("bil"), S.trilerp(c, 0.25, 0.6, 0.1).alias("tri")), "lin", "bil", "tri")


@query("s7_vector_interpolation", f"WITH {VECS} SELECT vec_id, round((u + v + w) * 0.3 + (s + t + r) * 0.7, 6) AS lin, round(((u + v + w) * 0.3 + (s + t + r) * 0.7) * 0.5 + ((s + t + r) * 0.3 + (u + v + w) * 0.7) * 0.5, 6) AS bil FROM vecs")
def s7(spark, d):
    df = vectors(spark, d).withColumns({"a": F.array("u", "v", "w"), "b": F.array("s", "t", "r")})
    a, b = F.col("a"), F.col("b")
    return rounded(df.select("vec_id", S.array_sum(S.vector_lerp(a, b, 0.3)).alias("lin"), S.array_sum(S.vector_bilerp([a, b, b, a], 0.3, 0.5)).alias("bil")), "lin", "bil")


@query("s8_nearest_corner", f"WITH {VECS} SELECT vec_id, CAST((u + 0.5 > 0.5)::INT + 2 * (v + 0.5 > 0.5)::INT + 4 * (w + 0.5 > 0.5)::INT AS INTEGER) AS corner FROM vecs")
def s8(spark, d):
    return vectors(spark, d).select("vec_id", S.nearest_corner([F.lit(i) for i in range(8)], [F.col(c) + 0.5 for c in "uvw"]).alias("corner"))


@query(
    "s9_vector_measures",
    f"WITH {VECS}, m AS (SELECT *, sqrt(u*u + v*v + w*w) AS m FROM vecs) SELECT vec_id, round(m, 6) AS mag, round(CASE WHEN m = 0 THEN u ELSE u / m END, 6) AS nu, round(greatest(u, v, w), 6) AS top, round(least(u * 20, 1.0), 6) AS clamped, (abs(u - s) <= 0.05 AND abs(v - t) <= 0.05 AND abs(w - r) <= 0.05) AS same FROM m",
)
def s9(spark, d):
    a, b = [F.col(c) for c in "uvw"], [F.col(c) for c in "str"]
    df = vectors(spark, d).select("vec_id", V.magnitude(a).alias("mag"), V.normalize(a)[0].alias("nu"), V.max_component(a).alias("top"), V.clamp_to_one(V.scale(a, 20.0))[0].alias("clamped"), V.same(a, b, 0.05).alias("same"))
    return rounded(df, "mag", "nu", "top", "clamped")


@query(
    "s10_vector_algebra",
    f"WITH {VECS} SELECT vec_id, round(u*s + v*t + w*r, 6) AS dot, round(v*r - w*t, 6) AS cx, round(w*s - u*r, 6) AS cy, round(u*t - v*s, 6) AS cz, round(u + s, 6) AS ax, round(v - t, 6) AS dy, (u < s AND v < t AND w < r) AS less FROM vecs",
)
def s10(spark, d):
    a, b = [F.col(c) for c in "uvw"], [F.col(c) for c in "str"]
    c = V.cross(a, b)
    df = vectors(spark, d).select("vec_id", V.dot(a, b).alias("dot"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), V.add(a, b)[0].alias("ax"), V.sub(a, b)[1].alias("dy"), V.less(a, b).alias("less"))
    return rounded(df, "dot", "cx", "cy", "cz", "ax", "dy")


@query("s11_matrix_vector", f"WITH {VECS} SELECT vec_id, round(u + 2*v + 3*w, 6) AS a, round(4*u + 5*v + 6*w, 6) AS b, round(7*u + 8*v + 10*w, 6) AS c, round(u + 4*v + 7*w, 6) AS left_a FROM vecs")
def s11(spark, d):
    m, a = [[1, 2, 3], [4, 5, 6], [7, 8, 10]], [F.col(c) for c in "uvw"]
    x, y = V.transform(m, a), V.transform_row(a, m)
    return rounded(vectors(spark, d).select("vec_id", x[0].alias("a"), x[1].alias("b"), x[2].alias("c"), y[0].alias("left_a")), "a", "b", "c", "left_a")


@query("s12_affine", f"WITH {VECS} SELECT vec_id, round(2 * (u * cos(radians(30)) - v * sin(radians(30))) + 1, 6) AS x, round(2 * (u * sin(radians(30)) + v * cos(radians(30))) - 1, 6) AS y, round(2 * w + 3, 6) AS z, round(u, 6) AS back FROM vecs")
def s12(spark, d):
    m = V.translation(1, -1, 3) @ V.scaling(2, 2, 2) @ V.rotation("z", 30)
    a = [*[F.col(c) for c in "uvw"], F.lit(1.0)]
    b = V.homogeneous(V.transform(m, a))
    back = V.transform(V.inverse(m), [*b, F.lit(1.0)])[0]
    return rounded(vectors(spark, d).select("vec_id", b[0].alias("x"), b[1].alias("y"), b[2].alias("z"), back.alias("back")), "x", "y", "z", "back")


_TH = "CASE WHEN u = 0 AND v = 0 THEN 0 ELSE pi() + atan2(v, u) END"
_PH = "CASE WHEN u = 0 AND v = 0 AND w = 0 THEN 0 ELSE abs(pi() / 2 - atan2(w, sqrt(u*u + v*v))) END"


@query("s13_s14_angles", f"WITH {VECS} SELECT vec_id, round({_TH}, 6) AS theta, round({_PH}, 6) AS phi FROM vecs")
def s13(spark, d):
    th, ph = S.direction_angles(*[F.col(c) for c in "uvw"])
    return rounded(vectors(spark, d).select("vec_id", th.alias("theta"), ph.alias("phi")), "theta", "phi")


@query("s15_spherical", f"WITH {VECS}, a AS (SELECT vec_id, sqrt(u*u + v*v + w*w) AS r, {_TH} AS t, {_PH} AS p FROM vecs) SELECT vec_id, round(r * sin(p) * cos(t), 6) AS x, round(r * sin(p) * sin(t), 6) AS y, round(r * cos(p), 6) AS z FROM a")
def s15(spark, d):
    x, y, z = S.cartesian(*S.spherical(*[F.col(c) for c in "uvw"]))
    return rounded(vectors(spark, d).select("vec_id", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query("s16_logarithm", "SELECT event_id, round(ln(value) / ln(3), 6) AS v FROM events WHERE value > 0")
def s16(spark, d):
    return table(spark, d, "events").where("value > 0").select("event_id", F.round(S.log_base(F.col("value"), 3), 6).alias("v"))


@query("s17_midpoint", f"WITH {VECS} SELECT vec_id, round((u + s) / 2, 6) AS a, round((v + t) / 2, 6) AS b FROM vecs")
def s17(spark, d):
    m = S.array_mean_with(F.array("u", "v"), F.array("s", "t"))
    return rounded(vectors(spark, d).select("vec_id", m[0].alias("a"), m[1].alias("b")), "a", "b")


@query("s18_ray_triangle", f"WITH {VECS} SELECT vec_id, (u >= -1e-9 AND v >= -1e-9 AND w >= -1e-9 AND u + v + w > 0) AS hit FROM vecs")
def s18(spark, d):
    p = [[F.lit(float(i == k)) for i in range(3)] for k in range(3)]
    return vectors(spark, d).select("vec_id", V.ray_hits_triangle([F.col(c) for c in "uvw"], *p).alias("hit"))


@query(
    "s20_feature_mappings",
    f"WITH {VECS} SELECT vec_id, round(u, 6) AS raw, round(sqrt(u*u + v*v + w*w), 6) AS abs, round(log10(sqrt(u*u + v*v + w*w)), 6) AS log, round(atan2(v, u), 6) AS dir FROM vecs",
)
def s20(spark, d):
    c = [F.col(n) for n in "uvw"]
    out = {"raw": S.feature(c[:1], "raw"), "abs": S.feature(c, "abs"), "log": S.feature(c, "log"), "dir": S.feature(c[:2], "dir")}
    return rounded(vectors(spark, d).select("vec_id", *[e.alias(k) for k, e in out.items()]), *out)


@query("s21_s22_bin_coordinate", f"WITH {VECS} SELECT vec_id, round(least(greatest((atan2(v, u) + 2.0) / (pi() + 2.0) * 90, 0), 90), 6) AS coordinate FROM vecs")
def s22(spark, d):
    v = S.feature([F.col("u"), F.col("v")], "dir")
    return rounded(vectors(spark, d).select("vec_id", S.bin_coordinate(v, S.default_range("dir", 2), (-2.0, 4.0), 90).alias("coordinate")), "coordinate")


@query("s23_magnitude", f"WITH {VECS} SELECT vec_id, round(sqrt(u*u + v*v + w*w), 6) AS m FROM vecs")
def s23(spark, d):
    return rounded(vectors(spark, d).select("vec_id", S.norm([F.col(c) for c in "uvw"]).alias("m")), "m")


@query("s24_finite", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS v FROM events")
def s24(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(math.inf)).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", S.finite(v).alias("v"))


@query("s25_clamped_index", f"WITH {CELLS}, g AS (SELECT max(z) AS zmax FROM cells) SELECT cell_id, CAST((least(greatest(z - 1, 0), zmax) * 10 + least(y + 1, 9)) * 10 + least(x + 3, 9) AS BIGINT) AS i FROM cells, g")
def s25(spark, d):
    df, g = event_grid(spark, d)
    return df.select("cell_id", g.clamped_id(F.col("x") + 3, F.col("y") + 1, F.col("z") - 1).cast("long").alias("i"))
