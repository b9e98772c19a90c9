"""Queries over polylines, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.lib.ordered import measured
from drivegrid.operators import corridor as co
from drivegrid.operators import polylines as pl
from drivegrid.operators import trajectory as tr
from drivegrid.plans.registry import query
from drivegrid.plans.tables import view, with_views
from drivegrid.plans.trajectory_queries import LINE, clean_line, q

SAMPLES = with_views("samples_v")
W = "WINDOW w AS (PARTITION BY run_id, edge_id ORDER BY i)"
ARC2 = SAMPLES + f""",
st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS d FROM samples_v {W}),
arc AS (SELECT *, sum(d) OVER (PARTITION BY run_id, edge_id ORDER BY i) AS s FROM st),
sg AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM arc {W}),
tot AS (SELECT run_id, edge_id, max(s) AS total, count(*) AS n FROM arc GROUP BY 1, 2)"""


def lines(spark, d):
    return measured(view(spark, d, "samples_v"))


def arcs(spark, d):
    return tr.arc_length(lines(spark, d), pl.EDGE, planar=True)


@query(
    "f10_heading_changes",
    SAMPLES + f""",
n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM samples_v {W})
SELECT edge_id, i, {Q('atan2(coalesce(ny, y) - coalesce(py, y), coalesce(nx, x) - coalesce(px, x))')} AS heading,
 {Q('coalesce(acos(greatest(-1, least(1, ((x-px)*(nx-x) + (y-py)*(ny-y)) / (sqrt((x-px)**2+(y-py)**2) * sqrt((nx-x)**2+(ny-y)**2))))), 0)', 4)} AS turn FROM n""",
)
def _(spark, d):
    return pl.heading_changes(lines(spark, d)).select("edge_id", "i", q("heading"), q("turn", 4))


@query(
    "f25_drop_consecutive_duplicates",
    SAMPLES + f""", r AS (SELECT run_id, edge_id, i, floor(x) AS x, floor(y) AS y FROM samples_v),
n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM r {W})
SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY i) - 1 AS i, x, y FROM n WHERE px IS NULL OR px <> x OR py <> y""",
)
def _(spark, d):
    r = lines(spark, d).select("run_id", "edge_id", "i", *[F.floor(c).cast("double").alias(c) for c in "xy"], F.lit(0.0).alias("z"))
    return pl.drop_consecutive_duplicates(r).select("edge_id", "i", "x", "y")


@query(
    "w8_densify",
    ARC2 + f""", p AS (SELECT *, greatest(1, coalesce(CAST(ceil(sqrt((x1-x)**2 + (y1-y)**2) / 7e-2) AS BIGINT), 1)) AS n FROM sg),
k AS (SELECT *, unnest(range(0, n)) AS j FROM p)
SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY i, j) - 1 AS i, {Q('x + (coalesce(x1, x) - x) * j / n')} AS x, {Q('z + (coalesce(z1, z) - z) * j / n')} AS z FROM k""",
)
def _(spark, d):
    return pl.densify(lines(spark, d), 0.07).select("edge_id", "i", q("x"), q("z"))


@query(
    "w6_sample_at_arc",
    ARC2 + f""", t AS (SELECT run_id, edge_id, k.v AS k, k.v * total / 40 - total / 80 AS t, total FROM tot, range(0, 43) k(v)),
c AS (SELECT *, least(greatest(t, 0), total) AS tt FROM t)
SELECT c.edge_id, k, {Q('x + (x1 - x) * (tt - s) / (s1 - s)')} AS x, {Q('y + (y1 - y) * (tt - s) / (s1 - s)')} AS y, {Q('z + (z1 - z) * (tt - s) / (s1 - s)')} AS z
FROM c JOIN sg ON sg.edge_id = c.edge_id AND s1 IS NOT NULL AND ((tt > s AND tt <= s1) OR (i = 0 AND tt <= 0))""",
)
def _(spark, d):
    arc = arcs(spark, d)
    tot = arc.groupBy(*pl.EDGE).agg(F.max("s").alias("total"))
    t = tot.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(42).cast("long"))))
    t = t.withColumn("t", F.col("k") * F.col("total") / 40 - F.col("total") / 80).drop("total")
    return pl.sample_at_arc(arc, t).select("edge_id", "k", q("x"), q("y"), q("z"))


@query(
    "w6_slice_polyline",
    ARC2 + f""", sp AS (SELECT run_id, edge_id, k.v AS slice_id, total * k.v / 7 AS s0, total * (k.v + 15e-1) / 7 AS s1 FROM tot, range(0, 5) k(v)),
tips AS (SELECT edge_id, slice_id, s0 AS t FROM sp UNION ALL SELECT edge_id, slice_id, s1 FROM sp),
pts AS (SELECT p.edge_id, slice_id, t AS s, x + (x1 - x) * (t - s) / (s1 - s) AS x FROM tips p JOIN sg ON sg.edge_id = p.edge_id AND s1 IS NOT NULL AND ((t > s AND t <= s1) OR (i = 0 AND t <= 0))
 UNION ALL SELECT sp.edge_id, slice_id, s, x FROM sp JOIN arc ON arc.edge_id = sp.edge_id AND s > s0 + 1e-9 AND s < s1 - 1e-9)
SELECT edge_id, slice_id, row_number() OVER (PARTITION BY edge_id, slice_id ORDER BY s) - 1 AS i, {Q('s')} AS s, {Q('x')} AS x FROM pts""",
)
def _(spark, d):
    arc = arcs(spark, d)
    tot = arc.groupBy(*pl.EDGE).agg(F.max("s").alias("total"))
    sp = tot.withColumn("slice_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    sp = sp.withColumns({"s0": F.col("total") * F.col("slice_id") / 7, "s1": F.col("total") * (F.col("slice_id") + 1.5) / 7})
    return pl.slice_lines(arc, sp.drop("total")).select("edge_id", "slice_id", "i", q("s"), q("x"))


def kernel(n: int) -> str:
    return f"""
a{n} AS (SELECT run_id, edge_id, i, x, y, sum(d) OVER (PARTITION BY run_id, edge_id ORDER BY i) AS s FROM
  (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS d FROM p{n - 1} {W})),
p{n} AS (SELECT a.run_id, a.edge_id, a.i, CASE WHEN a.i IN (0, 49) THEN any_value(a.x) ELSE sum(b.x * (1 - abs(b.s - a.s) / 6e-1)) / sum(1 - abs(b.s - a.s) / 6e-1) END AS x,
  CASE WHEN a.i IN (0, 49) THEN any_value(a.y) ELSE sum(b.y * (1 - abs(b.s - a.s) / 6e-1)) / sum(1 - abs(b.s - a.s) / 6e-1) END AS y
  FROM a{n} a JOIN a{n} b ON a.edge_id = b.edge_id AND abs(a.s - b.s) <= 6e-1 GROUP BY 1, 2, 3)"""


@query(
    "w9_smooth_by_arc",
    SAMPLES + ", p0 AS (SELECT run_id, edge_id, i, x, y FROM samples_v)," + kernel(1) + "," + kernel(2) + f" SELECT edge_id, i, {Q('x')} AS x, {Q('y')} AS y FROM p2",
)
def _(spark, d):
    return pl.smooth_by_arc(lines(spark, d), 1.2).select("edge_id", "i", q("x"), q("y"))


@query(
    "w10_limit_slope",
    ARC2.replace("WITH ", "WITH RECURSIVE ", 1) + f""", c AS (SELECT edge_id, i, s, 2e-1 + abs(x - floor(x)) * 3 AS c FROM arc),
f AS (SELECT edge_id, i, s, c AS v FROM c WHERE i = 0 UNION ALL SELECT c.edge_id, c.i, c.s, least(c.c, f.v + 8e-1 * (c.s - f.s)) FROM f JOIN c ON c.edge_id = f.edge_id AND c.i = f.i + 1),
b AS (SELECT edge_id, i, s, v FROM f WHERE i = 49 UNION ALL SELECT f.edge_id, f.i, f.s, least(f.v, b.v + 8e-1 * (b.s - f.s)) FROM b JOIN f ON f.edge_id = b.edge_id AND f.i = b.i - 1)
SELECT edge_id, i, {Q('v')} AS clearance FROM b""",
)
def _(spark, d):
    c = arcs(spark, d).withColumn("clearance", 0.2 + F.abs(F.col("x") - F.floor("x")) * 3)
    return pl.limit_slope(c, ["clearance"], 0.8).select("edge_id", "i", q("clearance"))


@query(
    "w11_max_curvature",
    ARC2 + f""", tg AS (SELECT a.edge_id, a.s AS c, total FROM arc a JOIN tot USING (run_id, edge_id) WHERE a.s >= 1 AND a.s <= total - 1
 UNION ALL SELECT edge_id, least(1 + k * 1e-1, total - 1), total FROM (SELECT *, unnest(range(0, CAST(floor((total - 2 + 1e-9) / 1e-1) AS BIGINT) + 1)) AS k FROM tot)),
t3 AS (SELECT row_number() OVER () AS id, * FROM tg),
pt AS (SELECT t.edge_id, t.id, o.v AS o, x + (x1 - x) * (tt - s) / (s1 - s) AS x, y + (y1 - y) * (tt - s) / (s1 - s) AS y FROM
  (SELECT *, least(greatest(c + o.v, 0), total) AS tt FROM t3, range(-1, 2) o(v)) t(id, edge_id, c, total, v, tt) JOIN range(-1, 2) o(v) ON o.v = t.v
  JOIN sg ON sg.edge_id = t.edge_id AND s1 IS NOT NULL AND ((tt > s AND tt <= s1) OR (i = 0 AND tt <= 0))),
tri AS (SELECT edge_id, id, max(CASE o WHEN -1 THEN x END) AS ax, max(CASE o WHEN -1 THEN y END) AS ay, max(CASE o WHEN 0 THEN x END) AS bx,
  max(CASE o WHEN 0 THEN y END) AS by_, max(CASE o WHEN 1 THEN x END) AS cx, max(CASE o WHEN 1 THEN y END) AS cy FROM pt GROUP BY 1, 2)
SELECT edge_id, {Q('max(2 * abs((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax)) / (sqrt((bx-ax)**2+(by_-ay)**2) * sqrt((cx-bx)**2+(cy-by_)**2) * sqrt((cx-ax)**2+(cy-ay)**2)))', 5)} AS max_curvature FROM tri GROUP BY 1""",
)
def _(spark, d):
    return pl.max_curvature(lines(spark, d), 1.0).select("edge_id", q("max_curvature", 5))


@query(
    "w13_turn_audit",
    SAMPLES + f""",
n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM samples_v {W}),
t AS (SELECT run_id, edge_id, i, coalesce(nx, x) - coalesce(px, x) AS tx, coalesce(ny, y) - coalesce(py, y) AS ty,
  coalesce(degrees(acos(greatest(-1, least(1, ((x-px)*(nx-x) + (y-py)*(ny-y)) / (sqrt((x-px)**2+(y-py)**2) * sqrt((nx-x)**2+(ny-y)**2)))))), 0) AS a FROM n),
m AS (SELECT *, tx * lag(tx) OVER w + ty * lag(ty) OVER w AS dot FROM t {W})
SELECT edge_id, count(*) FILTER (a >= 75) AS sharp_turns, count(*) FILTER (a >= 120) AS cusps, coalesce(bool_or(dot <= 0), FALSE) AS tangent_reversal, {Q('radians(max(a))', 4)} AS max_turn
FROM m GROUP BY edge_id""",
)
def _(spark, d):
    return pl.turn_audit(lines(spark, d)).select("edge_id", "sharp_turns", "cusps", "tangent_reversal", q("max_turn", 4))


SPLIT = LINE + """,
st AS (SELECT run_id, i, x, y, z, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2), 0) AS d, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny
  FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i)),
ar AS (SELECT *, sum(d) OVER (PARTITION BY run_id ORDER BY i) AS s, CASE WHEN nx IS NULL OR px IS NULL THEN TRUE ELSE
  degrees(acos(greatest(-1, least(1, ((x-px)*(nx-x) + (y-py)*(ny-y)) / (sqrt((x-px)**2+(y-py)**2) * sqrt((nx-x)**2+(ny-y)**2)))))) >= 75 END AS mark FROM st),
mk AS (SELECT run_id, i AS i0, s AS b0, lead(i) OVER w AS i1, lead(s) OVER w AS b1, row_number() OVER w AS k FROM ar WHERE mark WINDOW w AS (PARTITION BY run_id ORDER BY i)),
sp AS (SELECT *, greatest(1, CAST(ceil((b1 - b0) / (25e-2 - 2 * (1e-3 + 1e-9))) AS BIGINT)) AS n FROM mk WHERE b1 IS NOT NULL),
ct AS (SELECT *, CASE WHEN p = n THEN b1 ELSE b0 + (b1 - b0) * p / n END AS c FROM (SELECT *, unnest(range(0, n + 1)) AS p FROM sp)),
sn AS (SELECT c.run_id, c.k, c.p, c.n, coalesce((SELECT min_by(a.s, abs(a.s - c.c)) FROM ar a WHERE a.run_id = c.run_id AND a.i > c.i0 AND a.i < c.i1 AND abs(a.s - c.c) <= 1e-3 + 1e-9 AND c.p > 0 AND c.p < c.n), c.c) AS c FROM ct c),
pr AS (SELECT run_id, k, p, c AS s0, lead(c) OVER (PARTITION BY run_id, k ORDER BY p) AS s1 FROM sn),
ed AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY k, p) - 1 AS o, count(*) OVER (PARTITION BY run_id) AS total, s0, s1 FROM pr WHERE s1 IS NOT NULL)"""


@query(
    "w12_split_route",
    SPLIT + f" SELECT run_id, total + 2 + o AS edge_id, o + 1 AS from_id, o + 2 AS to_id, {Q('s0')} AS s0, {Q('s1')} AS s1 FROM ed",
)
def _(spark, d):
    edges, _ = pl.split_route(clean_line(spark, d), 0.25)
    return edges.select("run_id", "edge_id", "from_id", "to_id", q("s0"), q("s1"))


@query(
    "w12_split_route_vertices",
    SPLIT + f""" SELECT run_id, edge_id, count(*) AS n, {Q('sum(s)', 4)} AS sum_s FROM
 (SELECT e.run_id, total + 2 + o AS edge_id, s0 AS s FROM ed e UNION ALL SELECT run_id, total + 2 + o, s1 FROM ed
  UNION ALL SELECT e.run_id, total + 2 + o, a.s FROM ed e JOIN ar a ON a.run_id = e.run_id AND a.s > s0 + 1e-12 AND a.s < s1 - 1e-12) GROUP BY 1, 2""",
)
def _(spark, d):
    _, points = pl.split_route(clean_line(spark, d), 0.25)
    return points.groupBy("run_id", "edge_id").agg(F.count("*").alias("n"), quantize(F.sum("s"), 4).alias("sum_s"))


@query(
    "w16_geometry_audit",
    SAMPLES + f""",
v AS (SELECT run_id, edge_id, i, CASE WHEN (edge_id * 50 + i) % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x, y, z FROM samples_v),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, lead(i) OVER w AS ni FROM v {W}),
g AS (SELECT *, NOT isnan(x) AND NOT isnan(nx) AS ok FROM n WHERE ni IS NOT NULL),
m AS (SELECT *, CASE WHEN ok THEN abs(nz - z) END AS dz, CASE WHEN ok THEN sqrt((nx-x)**2 + (ny-y)**2) END AS f FROM g)
SELECT edge_id, count(*) AS segments, {Q('sum(f)')} AS planar_length, {Q('sum(sqrt(f*f + dz*dz))')} AS spatial_length, {Q('max(dz)')} AS max_dz,
 {Q('max(dz / f)', 5)} AS max_grade, max_by(i, dz / f) AS max_grade_segment, count(*) FILTER (NOT ok) AS nonfinite_segments,
 CASE WHEN bool_or(NOT ok) THEN 'nonfinite_centerline_segment' END AS reason FROM m GROUP BY edge_id""",
)
def _(spark, d):
    v = lines(spark, d).withColumn("x", F.when((F.col("edge_id") * 50 + F.col("i")) % 97 == 0, float("nan")).otherwise(F.col("x")))
    a = pl.geometry_audit(v)
    return a.select("edge_id", "segments", q("planar_length"), q("spatial_length"), q("max_dz"), q("max_grade", 5), "max_grade_segment", "nonfinite_segments", "reason")


@query(
    "w16_chain_breaks",
    SPLIT + """ SELECT run_id, total + 2 + o AS edge_id, 'chronological_edge_chain_disconnected' AS code FROM ed WHERE (total + 2 + o) % 10 <> 3 AND (total + 1 + o) % 10 = 3 AND o >= 2""",
)
def _(spark, d):
    edges, points = pl.split_route(clean_line(spark, d), 0.25)
    gone = edges.filter("edge_id % 10 <> 3")
    return pl.chain_breaks(gone, points.join(gone.select("run_id", "edge_id"), ["run_id", "edge_id"], "left_semi"))


@query(
    "w15_waypoint_yaw",
    SAMPLES + f""",
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM samples_v {W})
SELECT edge_id, i, {Q('atan2(coalesce(ny, fy) - y, coalesce(nx, fx) - x)')} AS yaw FROM n""",
)
def _(spark, d):
    return pl.waypoint_yaw(lines(spark, d), closed=True).select("edge_id", "i", q("yaw"))


@query(
    "w18_stable_tangent",
    ARC2 + f""",
pk AS (SELECT a.edge_id, a.i, max(CASE WHEN b.i <= a.i AND b.s <= a.s - 1 THEN b.i END) AS lo, min(CASE WHEN b.i >= a.i AND b.s >= a.s + 1 THEN b.i END) AS hi FROM arc a JOIN arc b ON a.edge_id = b.edge_id GROUP BY 1, 2),
dv AS (SELECT p.edge_id, p.i, h.x - l.x AS dx, h.y - l.y AS dy FROM pk p JOIN arc l ON l.edge_id = p.edge_id AND l.i = coalesce(lo, 0) JOIN arc h ON h.edge_id = p.edge_id AND h.i = coalesce(hi, 49))
SELECT edge_id, i, {Q('dx / sqrt(dx*dx + dy*dy)')} AS tx, {Q('dy / sqrt(dx*dx + dy*dy)')} AS ty FROM dv""",
)
def _(spark, d):
    return pl.stable_tangent(lines(spark, d), 1.0).select("edge_id", "i", q("tx"), q("ty"))


@query(
    "w19_fix_excursions",
    SAMPLES.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(x, 2) OVER w AS nx, lead(y, 2) OVER w AS ny FROM samples_v {W}),
l AS (SELECT *, sqrt((x-px)**2+(y-py)**2) AS l1, sqrt((bx-x)**2+(by_-y)**2) AS l2, sqrt((nx-bx)**2+(ny-by_)**2) AS l3 FROM n WHERE px IS NOT NULL AND nx IS NOT NULL),
c AS (SELECT *, (l1) / (l1+l2+l3) AS r1, (l1+l2) / (l1+l2+l3) AS r2 FROM l WHERE l2 < 5e-1
  AND degrees(acos(greatest(-1, least(1, ((x-px)*(bx-x) + (y-py)*(by_-y)) / (l1*l2))))) >= 75 AND degrees(acos(greatest(-1, least(1, ((bx-x)*(nx-bx) + (by_-y)*(ny-by_)) / (l2*l3))))) >= 75),
pick AS (SELECT edge_id, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT p.edge_id, m.i FROM pick p, LATERAL (SELECT min(c.i) AS i FROM c WHERE c.edge_id = p.edge_id AND c.i >= p.i + 2) m WHERE m.i IS NOT NULL),
f AS (SELECT c.edge_id, c.i, px + (nx-px)*r1 AS fx, py + (ny-py)*r1 AS fy FROM c JOIN pick USING (edge_id, i) UNION ALL SELECT c.edge_id, c.i + 1, px + (nx-px)*r2, py + (ny-py)*r2 FROM c JOIN pick USING (edge_id, i))
SELECT s.edge_id, s.i, {Q('coalesce(fx, x)')} AS x, {Q('coalesce(fy, y)')} AS y, fx IS NOT NULL AS moved FROM samples_v s LEFT JOIN f ON f.edge_id = s.edge_id AND f.i = s.i""",
)
def _(spark, d):
    return pl.fix_excursions(lines(spark, d)).select("edge_id", "i", q("x"), q("y"), "moved")


@query("w20_regularize_centerline", None)
def _(spark, d):
    return pl.regularize_centerline(lines(spark, d)).select("edge_id", "i", q("x"), q("y"), q("z"))


@query(
    "a12_polygon_area",
    SAMPLES + f""", n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM samples_v {W})
SELECT edge_id, {Q('sum(x * ny - nx * y) / 2')} AS area FROM n GROUP BY edge_id""",
)
def _(spark, d):
    return pl.polygon_area(lines(spark, d)).select("edge_id", q("area"))


OUTLINE = ", ".join(f"({a:.17e}, {b:.17e})" for a, b in co.outline(0.8, 0.9, 0.3))
SWEPT = ARC2 + f""",
sa AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, max(i) OVER e AS last, max(d) OVER e AS step, max(s) OVER e AS total FROM arc {W}, e AS (PARTITION BY run_id, edge_id)),
sb AS (SELECT *, dx / sqrt(dx * dx + dy * dy) AS tx, dy / sqrt(dx * dx + dy * dy) AS ty, greatest(1e-1, 5e-1 * step + 1e-1) AS cap FROM sa),
pa AS (SELECT run_id, edge_id, k, total, total * k / n AS t FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT run_id, edge_id, total, CAST(greatest(1, ceil(total / 1e-1)) AS BIGINT) AS n FROM tot))),
pb AS (SELECT run_id, edge_id, k, t, o.v AS o, least(greatest(t + o.v * 25e-2, 0), total) AS at FROM pa, range(-1, 2) o(v)),
pc AS (SELECT p.run_id, p.edge_id, p.k, p.t, p.o, g.x + (g.x1 - g.x) * (p.at - g.s) / (g.s1 - g.s) AS x, g.y + (g.y1 - g.y) * (p.at - g.s) / (g.s1 - g.s) AS y FROM pb p JOIN sg g ON g.run_id = p.run_id AND g.edge_id = p.edge_id AND ((p.at > g.s AND p.at <= g.s1) OR (g.i = 0 AND p.at <= 0)) AND g.s1 IS NOT NULL),
pd AS (SELECT run_id, edge_id, k, t, max(x) FILTER (o = 0) AS px, max(y) FILTER (o = 0) AS py, max(x) FILTER (o = 1) - max(x) FILTER (o = -1) AS ux, max(y) FILTER (o = 1) - max(y) FILTER (o = -1) AS uy FROM pc GROUP BY 1, 2, 3, 4),
bo(a, b) AS (VALUES {OUTLINE}),
pp AS (SELECT run_id, edge_id, t, px + ux / sqrt(ux * ux + uy * uy) * a - uy / sqrt(ux * ux + uy * uy) * b AS x, py + uy / sqrt(ux * ux + uy * uy) * a + ux / sqrt(ux * ux + uy * uy) * b AS y FROM pd, bo),
ob AS (SELECT s.run_id, s.edge_id, s.i, s.last, s.cap, (p.x - s.x) * s.tx + (p.y - s.y) * s.ty AS along, (p.y - s.y) * s.tx - (p.x - s.x) * s.ty AS lft FROM sb s JOIN pp p ON p.run_id = s.run_id AND p.edge_id = s.edge_id AND s.s - p.t >= -(3e-1 + s.cap) AND s.s - p.t <= 9e-1 + s.cap),
su AS (SELECT run_id, edge_id, i, max(lft) AS l, max(-lft) AS r FROM ob WHERE abs(along) <= cap OR (i = 0 AND along <= 0 AND along >= -35e-2) OR (i = last AND along >= 0 AND along <= 95e-2) GROUP BY 1, 2, 3),
sw AS (SELECT sb.*, greatest(4e-1, coalesce(l, 0)) AS l, greatest(4e-1, coalesce(r, 0)) AS r FROM sb LEFT JOIN su USING (run_id, edge_id, i)),
sx AS (SELECT *, greatest(l, coalesce(lag(l) OVER w, 0), coalesce(lead(l) OVER w, 0)) + 1e-1 + 5e-2 AS lo, greatest(r, coalesce(lag(r) OVER w, 0), coalesce(lead(r) OVER w, 0)) + 1e-1 + 5e-2 AS ro, CASE WHEN i = 0 THEN -35e-2 WHEN i = last THEN 95e-2 ELSE 0 END AS c FROM sw {W})"""


def swept(spark, d):
    return co.swept_corridor(lines(spark, d), 0.8, 0.9, 0.3, 0.1)


@query(
    "a20_swept_corridor",
    SWEPT + f""" SELECT run_id, edge_id, i, {Q('lo')} AS left_offset, {Q('ro')} AS right_offset, {Q('x - ty * lo + tx * c')} AS left_x, {Q('y + tx * lo + ty * c')} AS left_y, {Q('x + ty * ro + tx * c')} AS right_x, {Q('y - tx * ro + ty * c')} AS right_y FROM sx""",
)
def _(spark, d):
    return swept(spark, d).select("run_id", "edge_id", "i", q("left_offset"), q("right_offset"), q("left_x"), q("left_y"), q("right_x"), q("right_y"))
