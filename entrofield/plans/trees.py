"""Queries over space-partitioning trees of the event grid."""

from __future__ import annotations

from ..operators import tree
from ..operators.binning import with_bin
from .common import CELLS, event_grid, query, rounded, sql_bin, sql_entropy


def build(spark, d, mode: str, levels: int, **kw):
    df, g = event_grid(spark, d)
    bins = with_bin(df, 16).select("x", "y", "z", "bin")
    box = ((0, 0, 0), tuple(n - 1 for n in g.dims))
    return rounded(tree.build(bins, box, mode, 16, levels, **kw).frame(spark), "entropy")


_GRID = f"{CELLS}, g AS (SELECT max(z) AS zm FROM cells), r AS (SELECT min(value) AS lo, max(value) AS hi FROM cells), b AS (SELECT x, y, z, {sql_bin('value', 16)} AS bin FROM cells, r)"
_MID = "floor((lx + hx) / 2)", "floor((ly + hy) / 2)", "floor((lz + hz) / 2)"


def _fixed(boxes: str) -> str:
    """Nodes given by SQL boxes(path, level, lx..hz) with their cells and entropy."""
    return f"WITH {_GRID}, {boxes}, h AS (SELECT path, bin, count(*) AS n FROM boxes JOIN b ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY ALL), e AS ({sql_entropy('h', 'path')}), c AS (SELECT path, CAST(sum(n) AS BIGINT) AS cells FROM h GROUP BY path), o AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS node_id FROM boxes) SELECT CAST(o.node_id AS INTEGER) AS node_id, CAST(p.node_id AS INTEGER) AS parent_id, CAST(o.level AS INTEGER) AS level, " + ", ".join(f"CAST(o.{c} AS INTEGER) AS {c}" for c in ("lx", "ly", "lz", "hx", "hy", "hz")) + ", cells, entropy, (o.level = 1) AS is_leaf FROM o LEFT JOIN o p ON o.level = 1 AND p.level = 0 JOIN e ON e.path = o.path JOIN c ON c.path = o.path"


_ROOT = "SELECT '' AS path, 0 AS level, 0 AS lx, 0 AS ly, 0 AS lz, 9 AS hx, 9 AS hy, zm AS hz FROM g"


def _kids(kinds: list[tuple[str, ...]]) -> str:
    return "boxes AS (WITH root AS (" + _ROOT + ") SELECT * FROM root" + "".join(f" UNION ALL SELECT '{i}', 1, {', '.join(k)} FROM root" for i, k in enumerate(kinds)) + ")"


def _square(lz: str, hz: str) -> list[tuple[str, ...]]:
    mx, my, _ = _MID
    return [("lx", "ly", lz, mx, my, hz), (mx, "ly", lz, "hx", my, hz), (mx, my, lz, "hx", "hy", hz), ("lx", my, lz, mx, "hy", hz)]


@query("p1_octree", _fixed(_kids(_square("lz", _MID[2]) + _square(_MID[2], "hz"))))
def p1(spark, d):
    return build(spark, d, "octree", 1)


@query("p2_quadtree", _fixed(_kids(_square("lz", "hz"))))
def p2(spark, d):
    return build(spark, d, "quadtree", 1)


@query("p3_kd_middle", _fixed(_kids([("lx", "ly", "lz", _MID[0], "hy", "hz"), (_MID[0], "ly", "lz", "hx", "hy", "hz")])))
def p3(spark, d):
    return build(spark, d, "kd_middle", 1)


def _best(score: str) -> str:
    """The best split of the root among both axes and all fractions; equal scores go to the first candidate."""
    f = "(SELECT unnest(range(13)) AS i)"
    cand = f"k AS (SELECT 0 AS a, i, floor(9 * (0.2 + 0.05 * i) + 1e-9) AS m FROM {f} UNION ALL SELECT 1, i, floor(9 * (0.2 + 0.05 * i) + 1e-9) FROM {f})"
    side = "kh AS (SELECT a, i, m, s, bin, count(*) AS n FROM k, (SELECT unnest([0, 1]) AS s), b WHERE CASE WHEN a = 0 THEN x ELSE y END BETWEEN CASE WHEN s = 0 THEN 0 ELSE m END AND CASE WHEN s = 0 THEN m ELSE 9 END GROUP BY ALL)"
    ent = "ke AS (SELECT a, i, any_value(m) AS m, s, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM kh GROUP BY a, i, s)"
    top = f"kb AS (SELECT a, m FROM (SELECT a, i, any_value(m) AS m, {score}(h) AS v FROM ke GROUP BY a, i) ORDER BY v DESC, a, i LIMIT 1)"
    boxes = "boxes AS (SELECT * FROM (" + _ROOT + ") UNION ALL SELECT '0', 1, 0, 0, 0, CASE WHEN a = 0 THEN m ELSE 9 END, CASE WHEN a = 1 THEN m ELSE 9 END, zm FROM g, kb UNION ALL SELECT '1', 1, CASE WHEN a = 0 THEN m ELSE 0 END, CASE WHEN a = 1 THEN m ELSE 0 END, 0, 9, 9, zm FROM g, kb)"
    return _fixed(f"{cand}, {side}, {ent}, {top}, {boxes}")


@query("p4_max_entropy_split", _best("max"))
def p4(spark, d):
    return build(spark, d, "max_entropy", 1)


@query("p5_sum_entropy_split", _best("sum"))
def p5(spark, d):
    return build(spark, d, "sum_entropy", 1)


@query("p6_distance_split")
def p6(spark, d):
    return build(spark, d, "distance", 2)


@query("p8_p9_deep_tree")
def p8(spark, d):
    return build(spark, d, "octree", 3, min_cells=30)


@query("p2_quadtree_deep")
def p2_deep(spark, d):
    return build(spark, d, "quadtree", 3)


@query("p3_kd_middle_deep")
def p3_deep(spark, d):
    return build(spark, d, "kd_middle", 4)


@query("p4_max_entropy_split_deep")
def p4_deep(spark, d):
    return build(spark, d, "max_entropy", 3)


@query("p5_sum_entropy_split_deep")
def p5_deep(spark, d):
    return build(spark, d, "sum_entropy", 3)
