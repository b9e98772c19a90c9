"""Queries for lines, polygons and bodies against cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.lib.ordered import measured
from drivegrid.operators import polylines as pl
from drivegrid.operators import spatial as sp
from drivegrid.operators import trajectory as tr
from drivegrid.operators import validation as va
from drivegrid.plans.cell_queries import CELLED, fixed_cells
from drivegrid.plans.polyline_queries import ARC2, lines
from drivegrid.plans.registry import query
from drivegrid.plans.tables import view, with_views
from drivegrid.plans.trajectory_queries import q

# cells 0.5 m, origin (-1, -1), 60 x 60: the area of the sample lines
GRID = dict(ox=-1.0, oy=-1.0, n=60)
CELLS = """
cl AS (SELECT run_id, CAST(floor(x) AS BIGINT) % 60 AS cx, CAST(floor((y + 4) * 7) AS BIGINT) % 60 AS cy, count(*) FILTER (z > 1) AS hi, count(*) AS n FROM points_v GROUP BY 1, 2, 3),
cells AS (SELECT run_id, cx, cy, hi >= 2 AS obstacle, hi < 2 AND n = 1 AS unknown FROM cl)"""
SPT = ARC2 + ", " + with_views("points_v").replace("WITH ", "") + "," + CELLS


def grid_cells(spark, d):
    p = view(spark, d, "points_v")
    c = p.groupBy("run_id", (F.floor("x") % 60).alias("cx"), (F.floor((F.col("y") + 4) * 7) % 60).alias("cy")).agg(
        F.count_if(F.col("z") > 1).alias("hi"), F.count("*").alias("n")
    )
    cells = c.select("run_id", "cx", "cy", (F.col("hi") >= 2).alias("obstacle"), ((F.col("hi") < 2) & (F.col("n") == 1)).alias("unknown"))
    runs = p.select("run_id").distinct()
    grid = runs.withColumns({"origin_x": F.lit(-1.0), "origin_y": F.lit(-1.0), "width": F.lit(60).cast("long"), "height": F.lit(60).cast("long")})
    return cells, grid


TOUCH = """
pz AS (SELECT run_id, edge_id, i, x + (x1 - x) * j / n AS ax, y + (y1 - y) * j / n AS ay, x + (x1 - x) * (j + 1) / n AS bx, y + (y1 - y) * (j + 1) / n AS by_
  FROM (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, greatest(1, CAST(ceil(sqrt((x1-x)**2 + (y1-y)**2) / 25e-2) AS BIGINT)) AS n FROM sg WHERE x1 IS NOT NULL))),
cd AS (SELECT p.*, CAST(floor((least(ax, bx) + 1) / 5e-1) AS BIGINT) + dx.v AS cx, CAST(floor((least(ay, by_) + 1) / 5e-1) AS BIGINT) + dy.v AS cy FROM pz p, range(-1, 3) dx(v), range(-1, 3) dy(v)),
ht AS (SELECT *, -1 + cx * 5e-1 AS x0, -1 + cy * 5e-1 AS y0, bx - ax AS ux, by_ - ay AS uy FROM cd),
tc AS (SELECT run_id, edge_id, i, cx, cy FROM ht WHERE greatest(0, CASE WHEN abs(ux) > 1e-12 THEN least((x0-ax)/ux, (x0+5e-1-ax)/ux) ELSE 0 END, CASE WHEN abs(uy) > 1e-12 THEN least((y0-ay)/uy, (y0+5e-1-ay)/uy) ELSE 0 END)
  <= least(1, CASE WHEN abs(ux) > 1e-12 THEN greatest((x0-ax)/ux, (x0+5e-1-ax)/ux) ELSE 1 END, CASE WHEN abs(uy) > 1e-12 THEN greatest((y0-ay)/uy, (y0+5e-1-ay)/uy) ELSE 1 END) + 1e-12
  AND (abs(ux) > 1e-12 OR ax BETWEEN x0 - 1e-12 AND x0 + 5e-1 + 1e-12) AND (abs(uy) > 1e-12 OR ay BETWEEN y0 - 1e-12 AND y0 + 5e-1 + 1e-12))"""


@query(
    "j12_trace_cells",
    SPT + "," + TOUCH + """ SELECT t.edge_id, bool_or(t.cx < 0 OR t.cy < 0 OR t.cx >= 60 OR t.cy >= 60) AS outside, bool_or(coalesce(obstacle, FALSE)) AS occupied,
 bool_or(coalesce(unknown, TRUE) AND NOT coalesce(obstacle, FALSE)) AS unknown FROM tc t LEFT JOIN cells c ON c.run_id = t.run_id AND c.cx = t.cx AND c.cy = t.cy GROUP BY t.edge_id""",
)
def _(spark, d):
    cells, grid = grid_cells(spark, d)
    return sp.trace_lines(lines(spark, d), cells, grid, 0.5).select("edge_id", "outside", "occupied", "unknown")


# rays of 1.5 m in 6 pieces of a quarter metre
RAYS = SPT + """,
tg AS (SELECT run_id, edge_id, i, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM samples_v WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
ry AS (SELECT run_id, edge_id, i, x, y, sd.v AS side, -sd.v * dy / sqrt(dx*dx+dy*dy) AS nx, sd.v * dx / sqrt(dx*dx+dy*dy) AS ny FROM tg, (VALUES (1), (-1)) sd(v)),
pz AS (SELECT *, k.v AS piece, x + nx * 15e-1 * (k.v - 1) / 6 AS ax, y + ny * 15e-1 * (k.v - 1) / 6 AS ay, x + nx * 15e-1 * k.v / 6 AS bx, y + ny * 15e-1 * k.v / 6 AS by_ FROM ry, range(1, 7) k(v)),
cd AS (SELECT p.*, CAST(floor((least(ax, bx) + 1) / 5e-1) AS BIGINT) + dx.v AS cx, CAST(floor((least(ay, by_) + 1) / 5e-1) AS BIGINT) + dy.v AS cy FROM pz p, range(-1, 3) dx(v), range(-1, 3) dy(v)),
ht AS (SELECT *, -1 + cx * 5e-1 AS x0, -1 + cy * 5e-1 AS y0, bx - ax AS ux, by_ - ay AS uy FROM cd),
tc AS (SELECT * FROM ht WHERE greatest(0, CASE WHEN abs(ux) > 1e-12 THEN least((x0-ax)/ux, (x0+5e-1-ax)/ux) ELSE 0 END, CASE WHEN abs(uy) > 1e-12 THEN least((y0-ay)/uy, (y0+5e-1-ay)/uy) ELSE 0 END)
  <= least(1, CASE WHEN abs(ux) > 1e-12 THEN greatest((x0-ax)/ux, (x0+5e-1-ax)/ux) ELSE 1 END, CASE WHEN abs(uy) > 1e-12 THEN greatest((y0-ay)/uy, (y0+5e-1-ay)/uy) ELSE 1 END) + 1e-12
  AND (abs(ux) > 1e-12 OR ax BETWEEN x0 - 1e-12 AND x0 + 5e-1 + 1e-12) AND (abs(uy) > 1e-12 OR ay BETWEEN y0 - 1e-12 AND y0 + 5e-1 + 1e-12)),
kd AS (SELECT t.edge_id, t.i, side, piece, CASE WHEN t.cx < 0 OR t.cy < 0 OR t.cx >= 60 OR t.cy >= 60 THEN 0 WHEN NOT coalesce(obstacle, FALSE) AND coalesce(unknown, TRUE) THEN 1 WHEN obstacle THEN 2 END AS kind
  FROM tc t LEFT JOIN cells c ON c.run_id = t.run_id AND c.cx = t.cx AND c.cy = t.cy),
fh AS (SELECT edge_id, i, side, min(piece * 10 + kind) AS h FROM kd GROUP BY 1, 2, 3),
dd AS (SELECT edge_id, i, side, CASE WHEN h IS NULL THEN 15e-1 WHEN h % 10 = 0 THEN 0e0 ELSE greatest(0e0, 15e-1 * (h // 10 - 1) / 6 - 5e-2) END AS d, h IS NULL OR h % 10 = 2 AS seen FROM fh),
lc AS (SELECT edge_id, i, max(CASE side WHEN 1 THEN d END) AS l, max(CASE side WHEN -1 THEN d END) AS r, bool_or(side = 1 AND seen) AS lo, bool_or(side = -1 AND seen) AS ro FROM dd GROUP BY 1, 2)"""


def clearance(spark, d):
    cells, grid = grid_cells(spark, d)
    return sp.lateral_clearance(lines(spark, d), cells, grid, 0.5, 1.5, 0.25, 0.05)


@query("j13_lateral_clearance", RAYS + f" SELECT edge_id, i, {Q('l')} AS left_clearance, {Q('r')} AS right_clearance, lo AS left_observed, ro AS right_observed FROM lc")
def _(spark, d):
    return clearance(spark, d).select("edge_id", "i", q("left_clearance"), q("right_clearance"), "left_observed", "right_observed")


@query(
    "a14_edge_summary",
    RAYS + f""" SELECT edge_id, {Q('min(l + r)')} AS min_width, {Q('(count(*) FILTER (lo) + count(*) FILTER (ro)) / (2e0 * count(*))')} AS confidence, bool_and(lo AND ro) AS clearance_complete,
 count(*) FILTER (l + r < 2e-1) AS narrow_samples, count(*) FILTER (l + r < 2e-1) = 0 AS passable FROM lc GROUP BY edge_id""",
)
def _(spark, d):
    return sp.edge_summary(clearance(spark, d)).select("edge_id", q("min_width"), q("confidence"), "clearance_complete", "narrow_samples", "passable")


@query("v2_validate_edges", None)
def _(spark, d):
    """Every edge against the cells: clearance, corridor and body in one verdict."""
    cells, grid = grid_cells(spark, d)
    ls = lines(spark, d)
    body = va.Body(front=0.6, rear=0.3, width=0.5, min_turning_radius=0.5)
    out, _ = va.validate_edges(ls.select(*pl.EDGE).distinct(), ls, cells, grid, 0.5, body, max_length=40.0, half_width=1.5, ray_step=0.25)
    return out.select("run_id", "edge_id", F.array_join("errors", ",").alias("errors"), "status", q("min_width"), q("confidence"))


@query(
    "g5_self_intersections",
    ARC2 + """, zz AS (SELECT edge_id, (i * 7) % 50 AS i, x, y FROM samples_v),
s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM zz WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
p AS (SELECT a.edge_id, a.i, (a.x1-a.x)*(b.y-a.y) - (a.y1-a.y)*(b.x-a.x) AS o1, (a.x1-a.x)*(b.y1-a.y) - (a.y1-a.y)*(b.x1-a.x) AS o2, (b.x1-b.x)*(a.y-b.y) - (b.y1-b.y)*(a.x-b.x) AS o3,
  (b.x1-b.x)*(a.y1-b.y) - (b.y1-b.y)*(a.x1-b.x) AS o4 FROM s a JOIN s b ON a.edge_id = b.edge_id AND b.i > a.i + 1)
SELECT edge_id, count(DISTINCT i) AS crossings, min(i) AS first_i FROM p WHERE o1 * o2 < 0 AND o3 * o4 < 0 GROUP BY edge_id""",
)
def _(spark, d):
    # vertices visited in another order: lines that cross themselves often
    mixed = lines(spark, d).withColumn("i", F.pmod(F.col("i") * 7, F.lit(50)))
    return sp.self_intersections(measured(mixed)).select("edge_id", "crossings", "first_i")


# hexagons around every sample vertex; feature_id = edge_id * 50 + i
HEX = """, hx AS (SELECT run_id, edge_id * 50 + i AS feature_id, k.v AS i, x + 13e-1 * cos(k.v * pi() / 3 + edge_id) AS x, y + 9e-1 * sin(k.v * pi() / 3 + edge_id) AS y FROM samples_v, range(0, 6) k(v)),
he AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS qx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS qy FROM hx WINDOW w AS (PARTITION BY feature_id ORDER BY i))"""


def hexagons(spark, d):
    s = lines(spark, d)
    k = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    a = F.col("k") * math.pi / 3 + F.col("edge_id")
    h = k.select("run_id", (F.col("edge_id") * 50 + F.col("i")).alias("feature_id"), F.col("k").alias("i"), (F.col("x") + 1.3 * F.cos(a)).alias("x"), (F.col("y") + 0.9 * F.sin(a)).alias("y"))
    return measured(h)


PIP = HEX + """, pin AS (SELECT s.run_id, s.edge_id, s.i, h.feature_id FROM samples_v s JOIN he h ON h.run_id = s.run_id AND (h.y > s.y) <> (h.qy > s.y)
 AND h.x + (s.y - h.y) * (h.qx - h.x) / (h.qy - h.y) >= s.x GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)"""


@query("j16_point_in_polygon", ARC2 + PIP + " SELECT edge_id, i, feature_id FROM pin")
def _(spark, d):
    p = lines(spark, d).select("run_id", "edge_id", "i", "x", "y")
    return sp.points_in_polygons(p, hexagons(spark, d), ["run_id", "edge_id", "i"], ["run_id", "feature_id"]).select("edge_id", "i", "feature_id")


ARC3 = """, q3 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2), 0) AS d3 FROM samples_v WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
r3 AS (SELECT *, sum(d3) OVER (PARTITION BY edge_id ORDER BY i) AS s FROM q3),
g3 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(s) OVER w AS s1 FROM r3 WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
sg3 AS (SELECT * FROM g3 WHERE x1 IS NOT NULL)"""


@query(
    "j15_polygon_spans",
    ARC2 + HEX + ARC3 + f""",
cr AS (SELECT g.run_id, g.edge_id, g.i, h.feature_id, ((h.x-g.x)*(h.qy-h.y) - (h.y-g.y)*(h.qx-h.x)) / ((g.x1-g.x)*(h.qy-h.y) - (g.y1-g.y)*(h.qx-h.x)) AS t,
   ((h.x-g.x)*(g.y1-g.y) - (h.y-g.y)*(g.x1-g.x)) / ((g.x1-g.x)*(h.qy-h.y) - (g.y1-g.y)*(h.qx-h.x)) AS u FROM sg3 g JOIN he h ON h.run_id = g.run_id),
bx AS (SELECT feature_id, run_id, min(x) AS u0, max(x) AS u1, min(y) AS v0, max(y) AS v1 FROM hx GROUP BY 1, 2),
ca AS (SELECT g.*, b.feature_id FROM sg3 g JOIN bx b ON b.run_id = g.run_id AND least(g.x, g.x1) <= u1 AND greatest(g.x, g.x1) >= u0 AND least(g.y, g.y1) <= v1 AND greatest(g.y, g.y1) >= v0),
ct AS (SELECT run_id, edge_id, i, feature_id, unnest([0e0, 1e0]) AS t FROM ca UNION SELECT run_id, edge_id, i, feature_id, t FROM cr WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
pc AS (SELECT *, lead(t) OVER (PARTITION BY edge_id, i, feature_id ORDER BY t) AS t1 FROM ct),
md AS (SELECT p.*, g.x + (g.x1 - g.x) * (p.t + p.t1) / 2 AS mx, g.y + (g.y1 - g.y) * (p.t + p.t1) / 2 AS my, g.s + p.t * (g.s1 - g.s) AS a, g.s + p.t1 * (g.s1 - g.s) AS b FROM pc p JOIN sg3 g ON g.edge_id = p.edge_id AND g.i = p.i WHERE p.t1 > p.t + 1e-12),
ins AS (SELECT m.edge_id, m.feature_id, a, b FROM md m JOIN he h ON h.run_id = m.run_id AND h.feature_id = m.feature_id AND (h.y > my) <> (h.qy > my) AND h.x + (my - h.y) * (h.qx - h.x) / (h.qy - h.y) >= mx GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1)
SELECT edge_id, feature_id, count(*) AS spans, {Q('sum(b - a)', 5)} AS inside_length FROM (SELECT edge_id, feature_id, min(a) AS a, max(b) AS b FROM
 (SELECT *, sum(f) OVER (PARTITION BY edge_id, feature_id ORDER BY a) AS k FROM (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY edge_id, feature_id ORDER BY a) + 1e-8 THEN 0 ELSE 1 END AS f FROM ins WHERE b > a + 1e-8)) GROUP BY edge_id, feature_id, k) GROUP BY 1, 2""",
)
def _(spark, d):
    arc = tr.arc_length(lines(spark, d), pl.EDGE)
    s = sp.polygon_spans(arc, hexagons(spark, d))
    return s.groupBy("edge_id", "feature_id").agg(F.count("*").alias("spans"), quantize(F.sum(F.col("end_s") - F.col("start_s")), 5).alias("inside_length"))


@query(
    "j17_polygon_overlap",
    ARC2 + HEX + """,
ov AS (SELECT DISTINCT a.feature_id AS a_id, b.feature_id AS b_id FROM hx a JOIN he b ON b.run_id = a.run_id AND a.feature_id % 2 = 0 AND b.feature_id % 2 = 1 AND (b.y > a.y) <> (b.qy > a.y) AND b.x + (a.y - b.y) * (b.qx - b.x) / (b.qy - b.y) >= a.x GROUP BY a.feature_id, a.i, b.feature_id HAVING count(*) % 2 = 1),
ow AS (SELECT DISTINCT b.feature_id AS a_id, a.feature_id AS b_id FROM hx a JOIN he b ON b.run_id = a.run_id AND a.feature_id % 2 = 1 AND b.feature_id % 2 = 0 AND (b.y > a.y) <> (b.qy > a.y) AND b.x + (a.y - b.y) * (b.qx - b.x) / (b.qy - b.y) >= a.x GROUP BY a.feature_id, a.i, b.feature_id HAVING count(*) % 2 = 1),
oc AS (SELECT DISTINCT a.feature_id AS a_id, b.feature_id AS b_id FROM he a JOIN he b ON a.run_id = b.run_id AND a.feature_id % 2 = 0 AND b.feature_id % 2 = 1
  WHERE ((a.qx-a.x)*(b.y-a.y) - (a.qy-a.y)*(b.x-a.x)) * ((a.qx-a.x)*(b.qy-a.y) - (a.qy-a.y)*(b.qx-a.x)) < 0 AND ((b.qx-b.x)*(a.y-b.y) - (b.qy-b.y)*(a.x-b.x)) * ((b.qx-b.x)*(a.qy-b.y) - (b.qy-b.y)*(a.qx-b.x)) < 0)
SELECT a_id, b_id FROM ov UNION SELECT a_id, b_id FROM ow UNION SELECT a_id, b_id FROM oc""",
)
def _(spark, d):
    h = hexagons(spark, d)
    a = h.filter("feature_id % 2 = 0").withColumnRenamed("feature_id", "a_id")
    b = h.filter("feature_id % 2 = 1").withColumnRenamed("feature_id", "b_id")
    return sp.polygon_overlaps(a, b, "a_id", "b_id").select("a_id", "b_id")


@query(
    "j17_polygon_contained",
    ARC2 + HEX + """, ct AS (SELECT feature_id, avg(x) AS mx, avg(y) AS my FROM hx GROUP BY 1), sv AS (SELECT h.run_id, h.feature_id AS a_id, h.i, mx + (x - mx) * 4e-1 AS x, my + (y - my) * 4e-1 AS y FROM hx h JOIN ct USING (feature_id)),
iv AS (SELECT s.a_id, s.i, h.feature_id AS b_id FROM sv s JOIN he h ON h.run_id = s.run_id AND (h.y > s.y) <> (h.qy > s.y) AND h.x + (s.y - h.y) * (h.qx - h.x) / (h.qy - h.y) >= s.x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT a_id, b_id FROM iv GROUP BY 1, 2 HAVING count(*) = 6""",
)
def _(spark, d):
    h = hexagons(spark, d)
    center = h.groupBy("run_id", "feature_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    small = h.join(center, ["run_id", "feature_id"]).withColumns({"x": F.col("mx") + (F.col("x") - F.col("mx")) * 0.4, "y": F.col("my") + (F.col("y") - F.col("my")) * 0.4})
    small = small.select("run_id", F.col("feature_id").alias("a_id"), "i", "x", "y")
    return sp.polygon_contained(small, h.withColumnRenamed("feature_id", "b_id"), "a_id", "b_id").select("a_id", "b_id")


@query(
    "j18_coverage",
    ARC2 + ARC3 + f""", pj AS (SELECT run_id, x, y, x1, y1 FROM sg3 WHERE edge_id % 20 >= 10),
ln AS (SELECT *, greatest(1, CAST(ceil(sqrt((x1-x)**2+(y1-y)**2) / 2e-1) AS BIGINT)) AS n FROM sg3 WHERE edge_id % 20 < 10),
sm AS (SELECT run_id, edge_id, i, j, x + (x1-x)*j/n AS x, y + (y1-y)*j/n AS y FROM (SELECT *, unnest(range(0, n)) AS j FROM ln) UNION ALL SELECT run_id, edge_id, 49, 0, x, y FROM samples_v WHERE i = 49 AND edge_id % 20 < 10),
cv AS (SELECT DISTINCT s.edge_id, s.i, s.j FROM sm s JOIN pj p ON p.run_id = s.run_id WHERE sqrt((p.x + (p.x1-p.x) * least(1, greatest(0, ((s.x-p.x)*(p.x1-p.x)+(s.y-p.y)*(p.y1-p.y)) / ((p.x1-p.x)**2+(p.y1-p.y)**2))) - s.x)**2
   + (p.y + (p.y1-p.y) * least(1, greatest(0, ((s.x-p.x)*(p.x1-p.x)+(s.y-p.y)*(p.y1-p.y)) / ((p.x1-p.x)**2+(p.y1-p.y)**2))) - s.y)**2) <= 4e-1)
SELECT t.edge_id, samples, coalesce(c, 0) AS covered, {Q('coalesce(c, 0) / samples::DOUBLE')} AS coverage FROM (SELECT edge_id, count(*) AS samples FROM sm GROUP BY 1) t LEFT JOIN (SELECT edge_id, count(*) AS c FROM cv GROUP BY 1) u USING (edge_id)""",
)
def _(spark, d):
    ls = lines(spark, d)
    seg = sp.line_segments(ls).filter("edge_id % 20 >= 10")
    return sp.coverage(ls.filter("edge_id % 20 < 10"), seg, 0.4, pl.EDGE).select("edge_id", "samples", "covered", q("coverage"))


# anchors: sample vertices shifted aside
ANCH = ARC2 + ARC3 + """, an AS (SELECT run_id, edge_id * 100 + i AS anchor_id, x + 15e-2 AS x, y + (i % 5) * 1e-1 AS y, z FROM samples_v),
dj AS (SELECT a.anchor_id, g.edge_id, g.i, g.s, g.s1, a.x - g.x AS px, a.y - g.y AS py, a.z - g.z AS pz, g.x1-g.x AS dx, g.y1-g.y AS dy, g.z1-g.z AS dz FROM an a JOIN sg3 g ON g.run_id = a.run_id),
dr AS (SELECT *, least(1, greatest(0, (px*dx+py*dy+pz*dz) / (dx*dx+dy*dy+dz*dz))) AS r FROM dj),
de AS (SELECT *, sqrt((px-dx*r)**2 + (py-dy*r)**2 + (pz-dz*r)**2) AS dist FROM dr)"""


@query(
    "j19_project_to_graph",
    ANCH + f""", m AS (SELECT anchor_id, min(dist) AS dist FROM de GROUP BY 1)
SELECT d.anchor_id, arg_min(d.edge_id, d.dist) AS edge_id, {Q('min(d.dist)')} AS distance, {Q('arg_min(d.s + d.r * (d.s1 - d.s), d.dist)')} AS arc_s,
 count(DISTINCT d.edge_id) FILTER (d.dist <= m.dist + 1e-9) > 1 AS ambiguous FROM de d JOIN m USING (anchor_id) GROUP BY d.anchor_id""",
)
def _(spark, d):
    ls = lines(spark, d)
    a = ls.select("run_id", (F.col("edge_id") * 100 + F.col("i")).alias("anchor_id"), (F.col("x") + 0.15).alias("x"), (F.col("y") + (F.col("i") % 5) * 0.1).alias("y"), "z")
    return sp.project_to_graph(a, sp.line_segments(ls), 0.3, exhaustive=True).select("anchor_id", "edge_id", q("distance"), q("arc_s"), "ambiguous")


@query(
    "j22_auto_elevation",
    ARC2 + ARC3 + ", " + with_views("points_v").replace("WITH ", "") + f""", qs AS (SELECT run_id, edge_id * 100 + i AS anchor_id, x + 4 AS x, y - (i % 10) * 6e-1 AS y FROM samples_v),
dj AS (SELECT a.anchor_id, g.z + (g.z1 - g.z) * least(1, greatest(0, ((a.x-g.x)*(g.x1-g.x) + (a.y-g.y)*(g.y1-g.y)) / ((g.x1-g.x)**2 + (g.y1-g.y)**2))) AS z, sqrt((g.x + (g.x1-g.x) * least(1, greatest(0, ((a.x-g.x)*(g.x1-g.x) + (a.y-g.y)*(g.y1-g.y)) / ((g.x1-g.x)**2 + (g.y1-g.y)**2))) - a.x)**2
  + (g.y + (g.y1-g.y) * least(1, greatest(0, ((a.x-g.x)*(g.x1-g.x) + (a.y-g.y)*(g.y1-g.y)) / ((g.x1-g.x)**2 + (g.y1-g.y)**2))) - a.y)**2) AS dist FROM qs a JOIN sg3 g ON g.run_id = a.run_id AND g.x BETWEEN a.x - 6 AND a.x + 6),
nr AS (SELECT anchor_id, arg_min(z, dist) AS lz FROM dj WHERE dist <= 5e-1 GROUP BY 1),
pt AS (SELECT q.anchor_id, p.z, row_number() OVER (PARTITION BY anchor_id ORDER BY p.z) - 1 AS k, count(*) OVER (PARTITION BY anchor_id) AS n FROM qs q JOIN points_v p ON p.run_id = q.run_id AND (p.x - q.x)**2 + (p.y - q.y)**2 <= 1),
cz AS (SELECT anchor_id, max(z) AS cz FROM pt WHERE n >= 3 AND k = CAST(floor(15e-2 * (n - 1)) AS BIGINT) GROUP BY 1)
SELECT anchor_id, {Q('coalesce(lz, cz)')} AS z, CASE WHEN lz IS NOT NULL THEN 'route' WHEN cz IS NOT NULL THEN 'points' ELSE 'unavailable' END AS source FROM qs LEFT JOIN nr USING (anchor_id) LEFT JOIN cz USING (anchor_id)""",
)
def _(spark, d):
    ls = lines(spark, d)
    qs = ls.select("run_id", (F.col("edge_id") * 100 + F.col("i")).alias("anchor_id"), (F.col("x") + 4).alias("x"), (F.col("y") - (F.col("i") % 10) * 0.6).alias("y"))
    return sp.auto_elevation(qs, sp.line_segments(ls), view(spark, d, "points_v"), reach=0.5).select("anchor_id", q("z"), "source")


@query(
    "a21_route_vs_grid",
    SPT + """, dn AS (SELECT run_id, edge_id, x + (coalesce(x1, x)-x)*j/n AS x, y + (coalesce(y1, y)-y)*j/n AS y FROM (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, greatest(1, coalesce(CAST(ceil(sqrt((x1-x)**2+(y1-y)**2) / 125e-3) AS BIGINT), 1)) AS n FROM sg))),
dc AS (SELECT *, CAST(floor((x + 1) / 5e-1) AS BIGINT) AS cx, CAST(floor((y + 1) / 5e-1) AS BIGINT) AS cy FROM dn)
SELECT d.edge_id, count(*) FILTER (inside AND coalesce(obstacle, FALSE)) AS obstacle_samples, count(*) FILTER (inside AND NOT coalesce(obstacle, FALSE) AND coalesce(unknown, TRUE)) AS unknown_samples, count(*) FILTER (NOT inside) AS off_map_samples
FROM (SELECT *, cx >= 0 AND cy >= 0 AND cx < 60 AND cy < 60 AS inside FROM dc) d LEFT JOIN cells c ON c.run_id = d.run_id AND c.cx = d.cx AND c.cy = d.cy GROUP BY d.edge_id""",
)
def _(spark, d):
    cells, grid = grid_cells(spark, d)
    return sp.route_vs_grid(lines(spark, d), cells, grid, 0.5).select("edge_id", "obstacle_samples", "unknown_samples", "off_map_samples")


BODY = SPT + """,
yp AS (SELECT run_id, edge_id, i, x, y, (edge_id % 7) * 3e-1 + i * 5e-2 AS yaw FROM samples_v),
bb AS (SELECT *, x + cos(yaw) * 15e-2 AS mx, y + sin(yaw) * 15e-2 AS my, 45e-2 * abs(cos(yaw)) + 25e-2 * abs(sin(yaw)) AS ex, 45e-2 * abs(sin(yaw)) + 25e-2 * abs(cos(yaw)) AS ey FROM yp),
bc AS (SELECT b.*, mx - ex < -1 OR my - ey < -1 OR mx + ex > 29 OR my + ey > 29 AS outside, CAST(floor((mx + 1) / 5e-1) AS BIGINT) + dx.v AS cx, CAST(floor((my + 1) / 5e-1) AS BIGINT) + dy.v AS cy FROM bb b, range(-2, 3) dx(v), range(-2, 3) dy(v)),
bh AS (SELECT *, -1 + (cx + 5e-1) * 5e-1 - mx AS gx, -1 + (cy + 5e-1) * 5e-1 - my AS gy FROM bc),
ov AS (SELECT h.run_id, h.edge_id, h.i, h.cx, h.cy, outside, coalesce(obstacle, FALSE) AND h.cx >= 0 AND h.cy >= 0 AND h.cx < 60 AND h.cy < 60 AS o, NOT coalesce(obstacle, FALSE) AND coalesce(unknown, TRUE) AND h.cx >= 0 AND h.cy >= 0 AND h.cx < 60 AND h.cy < 60 AS u FROM bh h
  LEFT JOIN cells c ON c.run_id = h.run_id AND c.cx = h.cx AND c.cy = h.cy
  WHERE abs(cos(yaw) * gx + sin(yaw) * gy) <= 45e-2 + 25e-2 * (abs(cos(yaw)) + abs(sin(yaw))) AND abs(cos(yaw) * gy - sin(yaw) * gx) <= 25e-2 + 25e-2 * (abs(cos(yaw)) + abs(sin(yaw)))
  AND abs(gx) <= 25e-2 + ex AND abs(gy) <= 25e-2 + ey)"""


def overlap(spark, d):
    cells, grid = grid_cells(spark, d)
    p = lines(spark, d).select("run_id", "edge_id", "i", "x", "y", ((F.col("edge_id") % 7) * 0.3 + F.col("i") * 0.05).alias("yaw"))
    return p, sp.footprint_overlap(p, cells, grid, 0.5, "rectangle", 0.6, 0.3, 0.5)


@query("j14_footprint_overlap", BODY + " SELECT edge_id, i, count(*) FILTER (o) AS obstacle_cells, count(*) FILTER (u) AS unknown_cells, bool_or(outside) AS outside FROM ov GROUP BY 1, 2")
def _(spark, d):
    _, o = overlap(spark, d)
    return o.groupBy("edge_id", "i").agg(F.count_if("obstacle").alias("obstacle_cells"), F.count_if("unknown").alias("unknown_cells"), F.bool_or("outside").alias("outside"))


@query(
    "a22_body_passage_report",
    BODY + """, ps AS (SELECT run_id, edge_id, i, bool_or(o) AS o, bool_or(u) OR bool_or(outside) AS u, bool_or(outside) AS x FROM ov GROUP BY 1, 2, 3),
pe AS (SELECT edge_id, count(*) FILTER (o) AS obstacle_samples, count(*) FILTER (u) AS unknown_samples, count(*) FILTER (x) AS outside_samples FROM ps GROUP BY 1),
ce AS (SELECT edge_id, count(DISTINCT CASE WHEN o THEN cx * 1000 + cy END) AS obstacle_cells, count(DISTINCT CASE WHEN u THEN cx * 1000 + cy END) AS unknown_cells FROM ov GROUP BY 1)
SELECT edge_id, obstacle_samples, unknown_samples, outside_samples, obstacle_cells, unknown_cells,
 concat_ws(',', CASE WHEN obstacle_samples > 0 THEN 'body_footprint_overlaps_obstacle' END, CASE WHEN unknown_samples > 0 THEN 'body_footprint_overlaps_unknown' END, CASE WHEN outside_samples > 0 THEN 'body_footprint_outside_grid' END) AS hard_errors,
 obstacle_samples + unknown_samples + outside_samples = 0 AS hard_valid FROM pe JOIN ce USING (edge_id)""",
)
def _(spark, d):
    p, o = overlap(spark, d)
    e = p.groupBy("run_id", "edge_id").agg(F.count("*").alias("sample_count")).withColumns({"planar_length": F.lit(1.0), "max_curvature": F.lit(0.0)})
    r = sp.body_passage_report(o, e, 0.0, False)
    return r.select("edge_id", "obstacle_samples", "unknown_samples", "outside_samples", "obstacle_cells", "unknown_cells", F.array_join("hard_errors", ",").alias("hard_errors"), "hard_valid")


@query(
    "a22_body_passage_totals",
    BODY + """, ps AS (SELECT run_id, edge_id, i, bool_or(o) AS o, bool_or(o) OR bool_or(u) OR bool_or(outside) AS bad FROM ov GROUP BY 1, 2, 3),
pe AS (SELECT run_id, edge_id, bool_or(bad) AS bad, count(*) FILTER (o) AS o FROM ps GROUP BY 1, 2)
SELECT y.run_id, y.n AS total_samples, CAST(sum(o) AS BIGINT) AS obstacle_samples, count(*) FILTER (bad) AS hard_invalid_edges, count(*) FILTER (NOT bad) AS warning_edges, CAST(0 AS BIGINT) AS valid_edges, count(*) FILTER (bad) = 0 AS planning_body_passage_ready
FROM pe JOIN (SELECT run_id, count(*) AS n FROM yp GROUP BY 1) y USING (run_id) GROUP BY y.run_id, y.n""",
)
def _(spark, d):
    p, o = overlap(spark, d)
    e = p.groupBy("run_id", "edge_id").agg(F.count("*").alias("sample_count")).withColumns({"planar_length": F.lit(1.0), "max_curvature": F.lit(0.4)})
    return sp.body_passage_totals(sp.body_passage_report(o, e, 5.0, False))


@query(
    "a19_min_lanelet_width",
    ARC2 + f""", fr AS (SELECT edge_id, k.v AS k, total * k.v / 100 AS t FROM tot, range(0, 101) k(v)),
pt AS (SELECT f.edge_id, f.k, x + (x1-x)*(t-s)/(s1-s) AS x, y + (y1-y)*(t-s)/(s1-s) AS y FROM fr f JOIN sg g ON g.edge_id = f.edge_id AND s1 IS NOT NULL AND ((t > s AND t <= s1) OR (i = 0 AND t <= 0)))
SELECT a.edge_id, {Q('min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2))')} AS min_width FROM pt a JOIN pt b ON b.edge_id = a.edge_id + 1 AND b.k = a.k AND a.edge_id % 2 = 0 GROUP BY 1""",
)
def _(spark, d):
    ls = lines(spark, d)
    right = ls.filter("edge_id % 2 = 1").withColumns({"edge_id": F.col("edge_id") - 1, "run_id": (F.col("edge_id") - 1) % 10})
    return sp.min_lanelet_width(ls.filter("edge_id % 2 = 0"), right).select("edge_id", q("min_width"))


@query(
    "f31_stop_line_geometry",
    ARC2 + ARC3 + f""", stp AS (SELECT run_id, edge_id, max(s) AS total, max(s) * 4e-1 AS s FROM r3 GROUP BY 1, 2),
tp AS (SELECT edge_id, o.v AS o, s + o.v * 5e-2 AS t FROM stp, range(-1, 2) o(v)),
pp AS (SELECT t.edge_id, max(CASE o WHEN -1 THEN x + (x1-x)*(t-s)/(s1-s) END) AS ax, max(CASE o WHEN -1 THEN y + (y1-y)*(t-s)/(s1-s) END) AS ay, max(CASE o WHEN 0 THEN x + (x1-x)*(t-s)/(s1-s) END) AS mx, max(CASE o WHEN 0 THEN y + (y1-y)*(t-s)/(s1-s) END) AS my,
 max(CASE o WHEN 1 THEN x + (x1-x)*(t-s)/(s1-s) END) AS bx, max(CASE o WHEN 1 THEN y + (y1-y)*(t-s)/(s1-s) END) AS by_ FROM tp t JOIN sg3 g ON g.edge_id = t.edge_id AND t.t > g.s AND t.t <= g.s1 GROUP BY 1)
SELECT edge_id, {Q('mx')} AS x, {Q('mx - (by_ - ay) / sqrt((bx-ax)**2 + (by_-ay)**2) * 15e-1', 5)} AS left_x, {Q('my + (bx - ax) / sqrt((bx-ax)**2 + (by_-ay)**2) * 15e-1', 5)} AS left_y FROM pp""",
)
def _(spark, d):
    ls = lines(spark, d)
    st = tr.arc_length(ls, pl.EDGE).groupBy("run_id", "edge_id").agg((F.max("s") * 0.4).alias("s"))
    st = st.withColumns({"stop_id": F.col("edge_id"), "width": F.lit(3.0)})
    return sp.stop_line_geometry(st, ls).select("edge_id", q("x"), q("left_x", 5), q("left_y", 5))
