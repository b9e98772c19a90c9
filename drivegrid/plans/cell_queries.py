"""Queries over points and cells, each with its SQL check."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.operators import cells as ce
from drivegrid.operators import trajectory as tr
from drivegrid.plans.registry import query
from drivegrid.plans.tables import view, with_views
from drivegrid.plans.trajectory_queries import LINE, clean_line, q

POINTS = with_views("points_v")
BOTH = with_views("poses_v", "points_v") + LINE[len(with_views("poses_v")):]


@query(
    "f1_filter_points",
    POINTS + f"""SELECT run_id, scan_id, count(*) AS n, {Q('sum(z)', 4)} AS sum_z FROM points_v
WHERE z BETWEEN 1e-2 AND 12e-1 AND sqrt(x*x + y*y + z*z) BETWEEN 2 AND 40 GROUP BY 1, 2""",
)
def _(spark, d):
    p = ce.filter_points(view(spark, d, "points_v"), (0.01, 1.2), (2.0, 40.0))
    return p.groupBy("run_id", "scan_id").agg(F.count("*").alias("n"), quantize(F.sum("z"), 4).alias("sum_z"))


@query(
    "f22_every_nth",
    "SELECT event_id, user_id FROM events WHERE event_id % 7 = 0",
)
def _(spark, d):
    from drivegrid.plans.tables import table

    return ce.every_nth(table(spark, d, "events"), 7, "event_id").select("event_id", "user_id")


@query(
    "f30_preview_sample",
    LINE + """, n AS (SELECT run_id, count(*) AS c FROM line GROUP BY run_id)
SELECT run_id, i, seq FROM line JOIN n USING (run_id) WHERE i % CAST(ceil(c / 64e0) AS BIGINT) = 0""",
)
def _(spark, d):
    return ce.preview_sample(clean_line(spark, d), 64, "i").select("run_id", "i", "seq")


@query(
    "a1_voxelize",
    POINTS + f"""SELECT run_id, CAST(floor(x / 4e-1) AS BIGINT) AS vx, CAST(floor(y / 4e-1) AS BIGINT) AS vy, CAST(floor(z / 4e-1) AS BIGINT) AS vz,
 {Q('CAST(CAST(avg(x) AS FLOAT) AS DOUBLE)', 4)} AS x, {Q('CAST(CAST(avg(intensity) AS FLOAT) AS DOUBLE)', 3)} AS intensity,
 count(*) AS point_count, count(DISTINCT scan_id) AS observation_count
FROM points_v GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT scan_id) >= 2""",
)
def _(spark, d):
    v = ce.voxelize(view(spark, d, "points_v"), 0.4, 2)
    return v.select(
        "run_id", "vx", "vy", "vz", quantize(F.col("x").cast("double"), 4).alias("x"),
        quantize(F.col("intensity").cast("double"), 3).alias("intensity"), "point_count", "observation_count",
    )


@query(
    "a2_revoxelize",
    POINTS + f"""SELECT run_id, CAST(floor(x / 8e-1) AS BIGINT) AS vx, CAST(floor(y / 8e-1) AS BIGINT) AS vy, CAST(floor(z / 8e-1) AS BIGINT) AS vz,
 {Q('CAST(CAST(avg(y) AS FLOAT) AS DOUBLE)', 4)} AS y, count(*) AS point_count, max(greatest(1, observation_count - 3)) AS observation_count
FROM points_v GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    p = view(spark, d, "points_v").withColumn("observation_count", F.col("observation_count") - 3)
    v = ce.revoxelize(p, 0.8)
    return v.select("run_id", "vx", "vy", "vz", quantize(F.col("y").cast("double"), 4).alias("y"), "point_count", "observation_count")


GRID = """,
box AS (SELECT run_id, min(x) - {c} AS ox, min(y) - {c} AS oy, max(x) + {c} AS x1, max(y) + {c} AS y1 FROM line GROUP BY run_id),
grid AS (SELECT run_id, ox, oy, CAST(ceil((x1 - ox) / {r}) AS BIGINT) + 1 AS w, CAST(ceil((y1 - oy) / {r}) AS BIGINT) + 1 AS h FROM box)"""


@query(
    "a9_grid_extent",
    LINE + GRID.format(c="6e0", r="1e-1") + f""" SELECT run_id, {Q('ox')} AS origin_x, {Q('oy')} AS origin_y, w AS width, h AS height,
 w * h > 90000 AS over_limit FROM grid""",
)
def _(spark, d):
    g = ce.grid_extent(clean_line(spark, d), 6.0, 0.1, 90_000)
    return g.select("run_id", q("origin_x"), q("origin_y"), "width", "height", "over_limit")


NEAREST = GRID.format(c="2e0", r="5e-1") + """,
yawed AS (SELECT *, atan2(2 * (qw*qz + qx*qy) / n, 1 - 2 * (qy*qy + qz*qz) / n) AS yaw FROM (SELECT *, qx*qx+qy*qy+qz*qz+qw*qw AS n FROM line)),
cand AS (SELECT l.run_id, l.i, l.x, l.y, l.z, l.yaw, g.ox, g.oy, g.w, g.h, CAST(floor((l.x - ox) / 5e-1) AS BIGINT) + dx.v AS cx,
  CAST(floor((l.y - oy) / 5e-1) AS BIGINT) + dy.v AS cy FROM yawed l JOIN grid g USING (run_id), range(-4, 5) dx(v), range(-4, 5) dy(v)),
dist AS (SELECT *, (ox + (cx + 5e-1) * 5e-1 - x)**2 + (oy + (cy + 5e-1) * 5e-1 - y)**2 AS d2 FROM cand WHERE cx >= 0 AND cy >= 0 AND cx < w AND cy < h),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cx, cy ORDER BY d2, i) AS rn FROM dist WHERE d2 <= 4e0) WHERE rn = 1)
"""


def nearest(spark, d):
    line = clean_line(spark, d)
    grid = ce.grid_extent(line, 2.0, 0.5)
    return line, grid, ce.nearest_pose_per_cell(line, grid, 2.0, 0.5)


@query("j6_nearest_pose_per_cell", LINE + NEAREST + f"SELECT run_id, cx, cy, i AS pose_i, {Q('d2')} AS d2 FROM nearest")
def _(spark, d):
    return nearest(spark, d)[2].select("run_id", "cx", "cy", "pose_i", q("d2"))


ASSIGNED = NEAREST + """, assigned AS (SELECT p.*, n.i AS pose_i, n.x AS px, n.y AS py, n.z AS pz FROM points_v p JOIN grid g USING (run_id)
  JOIN nearest n ON n.run_id = p.run_id AND n.cx = CAST(floor((p.x - g.ox) / 5e-1) AS BIGINT) AND n.cy = CAST(floor((p.y - g.oy) / 5e-1) AS BIGINT))
"""


@query(
    "j7_assign_points",
    BOTH + ASSIGNED + f"""SELECT run_id, pose_i, count(*) AS n, {Q('sum(z)', 4)} AS sum_z FROM assigned
WHERE (x-px)**2 + (y-py)**2 <= 225e-2 GROUP BY 1, 2""",
)
def _(spark, d):
    line, grid, near = nearest(spark, d)
    a = ce.assign_points(view(spark, d, "points_v"), near, grid, 0.5, 1.5)
    return a.groupBy("run_id", "pose_i").agg(F.count("*").alias("n"), quantize(F.sum("z"), 4).alias("sum_z"))


# a fixed grid over the point area: origin (0, -5), half-metre cells
FIX = dict(origin_x=0.0, origin_y=-5.0, width=150, height=20)


def fixed_grid(df):
    """One grid row per run of ``df``."""
    runs = df.select("run_id").distinct()
    return runs.withColumns({
        "origin_x": F.lit(0.0), "origin_y": F.lit(-5.0), "width": F.lit(150).cast("long"), "height": F.lit(20).cast("long")
    })


def fixed_cells(spark, d):
    p = view(spark, d, "points_v")
    return p, fixed_grid(p), ce.to_cells(p.withColumns({"origin_x": F.lit(0.0), "origin_y": F.lit(-5.0)}), 0.5).drop("origin_x", "origin_y")


CELLED = POINTS + """,
pc AS (SELECT *, CAST(floor(x / 5e-1) AS BIGINT) AS cx, CAST(floor((y + 5) / 5e-1) AS BIGINT) AS cy, observation_count AS weight FROM points_v)"""
GROUND = CELLED + """,
zs AS (SELECT run_id, cx, cy, z, weight, sum(weight) OVER (PARTITION BY run_id, cx, cy ORDER BY z) AS cum,
  sum(weight) OVER (PARTITION BY run_id, cx, cy) AS total, count(*) OVER (PARTITION BY run_id, cx, cy) AS n FROM pc),
ground AS (SELECT run_id, cx, cy, min(z) AS ground_z, max(n) AS points FROM zs WHERE n >= 2 AND cum > floor(3e-1 * (total - 1)) GROUP BY 1, 2, 3)
"""


def ground_cells(pc):
    return ce.ground_height_per_cell(pc.withColumn("weight", F.col("observation_count")), 0.3, 2)


@query("a3_ground_height", GROUND + f"SELECT run_id, cx, cy, {Q('ground_z')} AS ground_z, points FROM ground")
def _(spark, d):
    return ground_cells(fixed_cells(spark, d)[2]).select("run_id", "cx", "cy", q("ground_z"), "points")


PLANE = GROUND + """,
qs AS (SELECT DISTINCT run_id, fx, fy, (fx + 5e-1) * 25e-2 AS qx, -5 + (fy + 5e-1) * 25e-2 AS qy FROM
  (SELECT run_id, CAST(floor(x / 25e-2) AS BIGINT) AS fx, CAST(floor((y + 5) / 25e-2) AS BIGINT) AS fy FROM points_v)),
nb AS (SELECT q.run_id, fx, fy, (g.cx + 5e-1) * 5e-1 - qx AS dx, -5 + (g.cy + 5e-1) * 5e-1 - qy AS dy, g.ground_z AS z,
   g.cx = CAST(floor(qx / 5e-1) AS BIGINT) AND g.cy = CAST(floor((qy + 5) / 5e-1) AS BIGINT) AS own
  FROM qs q JOIN ground g ON g.run_id = q.run_id AND g.cx BETWEEN CAST(floor(qx / 5e-1) AS BIGINT) - 3 AND CAST(floor(qx / 5e-1) AS BIGINT) + 3
    AND g.cy BETWEEN CAST(floor((qy + 5) / 5e-1) AS BIGINT) - 3 AND CAST(floor((qy + 5) / 5e-1) AS BIGINT) + 3),
wt AS (SELECT *, CASE WHEN dx*dx + dy*dy <= 225e-2 THEN 1 / (1 + (dx*dx + dy*dy) / 225e-2) END AS w FROM nb),
mm AS (SELECT run_id, fx, fy, count(w) AS n, max(CASE WHEN own THEN z END) AS direct, sum(w) AS s, sum(w*dx) AS sx, sum(w*dy) AS sy, sum(w*z) AS sz,
  sum(w*dx*dx) AS sxx, sum(w*dx*dy) AS sxy, sum(w*dy*dy) AS syy, sum(w*dx*z) AS sxz, sum(w*dy*z) AS syz FROM wt GROUP BY 1, 2, 3),
dt AS (SELECT *, sxx*(syy*s - sy*sy) - sxy*(sxy*s - sy*sx) + sx*(sxy*sy - syy*sx) AS det FROM mm),
sol AS (SELECT *, (sxz*(syy*s - sy*sy) - sxy*(syz*s - sy*sz) + sx*(syz*sy - syy*sz)) / det AS a,
  (sxx*(syz*s - sz*sy) - sxz*(sxy*s - sy*sx) + sx*(sxy*sz - syz*sx)) / det AS b,
  (sxx*(syy*sz - syz*sy) - sxy*(sxy*sz - syz*sx) + sxz*(sxy*sy - syy*sx)) / det AS c FROM dt),
res AS (SELECT w.run_id, w.fx, w.fy, sqrt(sum(w * (z - a*dx - b*dy - c)**2) / sum(w)) AS rms FROM wt w JOIN sol USING (run_id, fx, fy) WHERE w IS NOT NULL GROUP BY 1, 2, 3),
fit AS (SELECT q.run_id, q.fx, q.fy, coalesce(n >= 5 AND abs(det) >= 1e-9 AND sqrt(a*a + b*b) <= 3e-1 AND rms <= 12e-2, FALSE) AS fitted, c, direct
  FROM qs q LEFT JOIN sol USING (run_id, fx, fy) LEFT JOIN res USING (run_id, fx, fy))
"""


def local_plane(spark, d):
    p, grid, pc = fixed_cells(spark, d)
    at = lambda c, o: F.floor((F.col(c) - o) / F.lit(0.25))
    fine = p.select("run_id", at("x", 0.0).alias("fx"), at("y", -5.0).alias("fy")).distinct()
    qs = fine.withColumns({"x": (F.col("fx") + 0.5) * 0.25, "y": F.lit(-5.0) + (F.col("fy") + 0.5) * 0.25})
    return ce.fit_local_plane(qs, ground_cells(pc), grid, 0.5, 1.5, 5, 0.3, 0.12, ("run_id", "fx", "fy"))


@query(
    "a4_fit_local_plane",
    PLANE + f"SELECT run_id, fx, fy, {Q('CASE WHEN fitted THEN c ELSE direct END', 5)} AS ground_z, fitted FROM fit",
)
def _(spark, d):
    return local_plane(spark, d).select("run_id", "fx", "fy", q("ground_z", 5), "fitted")


EVIDENCE = GROUND + """,
hz AS (SELECT p.*, p.z - g.ground_z AS hgt FROM pc p LEFT JOIN ground g USING (run_id, cx, cy)),
ev AS (SELECT run_id, cx, cy, count(*) FILTER (hgt BETWEEN 12e-2 AND 12e-1) AS obstacle_points, count(*) FILTER (abs(hgt) <= 8e-2) AS ground_points,
  coalesce(max(CASE WHEN hgt BETWEEN 12e-2 AND 12e-1 THEN observation_count END), 0) AS max_observations,
  count(*) FILTER (hgt IS NULL) AS unknown_points FROM hz GROUP BY 1, 2, 3)"""
BAND = (0.12, 1.2)


def evidence(spark, d):
    p, grid, pc = fixed_cells(spark, d)
    return ce.cell_evidence(ce.height_above_ground(pc, ground_cells(pc)), ce.collision_band(0.08, 1.2, *(0.12, 2.0)), 0.08)


@query("a5_cell_evidence", EVIDENCE + " SELECT * FROM ev")
def _(spark, d):
    return evidence(spark, d)


@query(
    "j8_points_over_ground",
    EVIDENCE + f""" SELECT run_id, count(*) FILTER (hgt IS NOT NULL) AS known, count(*) FILTER (hgt IS NULL) AS ground_unknown, {Q('sum(hgt)', 4)} AS sum_height
FROM hz GROUP BY run_id""",
)
def _(spark, d):
    p, grid, pc = fixed_cells(spark, d)
    h = ce.height_above_ground(pc, ground_cells(pc))
    return h.groupBy("run_id").agg(
        F.count("height").alias("known"), F.count_if(F.col("height").isNull()).alias("ground_unknown"),
        quantize(F.sum("height"), 4).alias("sum_height"),
    )


@query(
    "f26_collision_band",
    GROUND + """ SELECT run_id, cx, cy, count(*) AS n FROM (SELECT p.*, p.z - g.ground_z AS hgt FROM pc p JOIN ground g USING (run_id, cx, cy))
WHERE hgt >= greatest(8e-2, 12e-2) AND hgt <= least(12e-1, 2) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    p, grid, pc = fixed_cells(spark, d)
    band = ce.collision_band(0.08, 1.2, 0.12, 2.0)
    h = ce.height_above_ground(pc, ground_cells(pc)).filter(F.col("height").between(*band))
    return h.groupBy("run_id", "cx", "cy").agg(F.count("*").alias("n"))


SUPPORT = EVIDENCE + """,
sup AS (SELECT a.run_id, a.cx, a.cy, CAST(sum(b.obstacle_points) AS BIGINT) AS neighbour_points, any_value(a.obstacle_points) AS obstacle_points,
  any_value(a.max_observations) AS max_observations FROM ev a JOIN ev b ON a.run_id = b.run_id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1
  WHERE a.obstacle_points > 0 GROUP BY 1, 2, 3),
supp AS (SELECT *, (obstacle_points >= 3 OR neighbour_points >= 5) AND max_observations >= 6 AS supported FROM sup),
cls AS (SELECT e.run_id, e.cx, e.cy, coalesce(supported, FALSE) AS obstacle, supported IS NULL AND ground_points >= 2 AS observed_free,
  NOT coalesce(supported, FALSE) AND NOT (supported IS NULL AND ground_points >= 2) AS unknown, coalesce(NOT supported, FALSE) AS low_support
  FROM ev e LEFT JOIN supp USING (run_id, cx, cy))"""


def support(spark, d):
    ev = evidence(spark, d)
    return ev, ce.supported_cells(ev, 3, 1, 5, 6)


@query("a6_supported_cells", SUPPORT + " SELECT * FROM supp")
def _(spark, d):
    return support(spark, d)[1]


def classes(spark, d):
    ev, s = support(spark, d)
    return ce.classify_cells(ev, s, True, 2)


@query("a7_classify_cells", SUPPORT + " SELECT * FROM cls")
def _(spark, d):
    return classes(spark, d)


@query(
    "a10_cell_partition_audit",
    SUPPORT + """ SELECT run_id, CAST(3000 AS BIGINT) AS cells, count(*) FILTER (obstacle) AS obstacle, count(*) FILTER (observed_free) AS free,
 3000 - count(*) + count(*) FILTER (unknown) AS unknown, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS unclassified FROM cls GROUP BY run_id""",
)
def _(spark, d):
    c = classes(spark, d)
    return ce.cell_partition_audit(c, fixed_grid(view(spark, d, "points_v")))


@query(
    "j9_inflate",
    SUPPORT + """ SELECT DISTINCT run_id, cx + dx.v AS cx, cy + dy.v AS cy FROM cls, range(-3, 4) dx(v), range(-3, 4) dy(v)
WHERE obstacle AND (dx.v * 5e-1)**2 + (dy.v * 5e-1)**2 <= 12e-1**2 AND cx + dx.v BETWEEN 0 AND 149 AND cy + dy.v BETWEEN 0 AND 19""",
)
def _(spark, d):
    c = classes(spark, d)
    return ce.inflate(c.filter("obstacle"), fixed_grid(view(spark, d, "points_v")), 1.2, 0.5)


# body 1.0 m ahead, 0.5 m behind, 0.8 m wide, clearance 0.1 m, half-metre cells, 72 yaw bins
_M = 0.5 * math.sqrt(2.0) * 0.5 + math.hypot(1.0, 0.4) * math.sin(math.pi / 72)
_REACH = int(math.ceil(math.hypot(1.1 + _M, 0.5 + _M) / 0.5))
ORIENTED = SUPPORT.replace("WITH ", with_views("poses_v") + LINE[len(with_views("poses_v")):] + NEAREST.replace("grid ", "pgrid ").replace("box ", "pbox ").replace("FROM box", "FROM pbox").replace("JOIN grid", "JOIN pgrid") + ", ", 1)


@query(
    "j10_inflate_oriented",
    ORIENTED + f""",
yb AS (SELECT run_id, cx, cy, CAST(floor((yaw - floor(yaw / (2 * pi())) * (2 * pi())) * 72 / (2 * pi()) + 5e-1) AS BIGINT) % 72 AS b FROM nearest),
tg AS (SELECT run_id, cx, cy, cos(b * pi() / 36) AS c, sin(b * pi() / 36) AS s FROM yb),
st AS (SELECT t.*, cx + dx.v AS ax, cy + dy.v AS ay FROM tg t, range(-{_REACH}, {_REACH + 1}) dx(v), range(-{_REACH}, {_REACH + 1}) dy(v)
  WHERE (c * dx.v + s * dy.v) * 5e-1 BETWEEN -({0.6 + _M!r}) AND {1.1 + _M!r} AND abs(c * dy.v - s * dx.v) * 5e-1 <= {0.5 + _M!r})
SELECT DISTINCT st.run_id, st.cx, st.cy FROM st LEFT JOIN cls ON cls.run_id = st.run_id AND cls.cx = ax AND cls.cy = ay
WHERE ax < 0 OR ay < 0 OR ax >= 150 OR ay >= 20 OR coalesce(obstacle, FALSE)""",
)
def _(spark, d):
    c = classes(spark, d)
    near = nearest(spark, d)[2].select("run_id", "cx", "cy", F.col("pose_yaw").alias("yaw"))
    grid = fixed_grid(view(spark, d, "points_v"))
    return ce.inflate_oriented(c.filter("obstacle"), near, grid, 0.5, 1.0, 0.5, 0.8, 0.1)


_SM = 0.5 * math.sqrt(2.0) * 0.5
SWEEP = with_views("poses_v") + LINE[len(with_views("poses_v")):] + f""",
yw AS (SELECT run_id, i, x, y, atan2(2 * (qw*qz + qx*qy) / n, 1 - 2 * (qy*qy + qz*qz) / n) AS yaw FROM (SELECT *, qx*qx+qy*qy+qz*qz+qw*qw AS n FROM line)),
nx AS (SELECT *, coalesce(lead(x) OVER w, x) AS x1, coalesce(lead(y) OVER w, y) AS y1, coalesce(lead(yaw) OVER w, yaw) AS w1 FROM yw WINDOW w AS (PARTITION BY run_id ORDER BY i)),
tn AS (SELECT *, CASE WHEN abs(w1 - yaw) <= pi() THEN w1 - yaw WHEN w1 > yaw THEN w1 - yaw - 2 * pi() ELSE w1 - yaw + 2 * pi() END AS t FROM nx),
pc2 AS (SELECT *, greatest(1, CAST(ceil((sqrt((x1-x)**2 + (y1-y)**2) + abs(t) * {{radius}}) / 25e-2) AS BIGINT)) AS k FROM tn),
ps AS (SELECT run_id, x + (x1 - x) * j / k AS x, y + (y1 - y) * j / k AS y, yaw + t * j / k AS yaw FROM (SELECT *, unnest(range(0, k)) AS j FROM pc2))
"""


@query(
    "j11_sweep_rectangle",
    SWEEP.format(radius=repr(math.hypot(0.6, 0.25))) + f"""
SELECT DISTINCT run_id, cx + dx.v AS cx, cy + dy.v AS cy FROM
 (SELECT *, CAST(floor(x / 5e-1) AS BIGINT) AS cx, CAST(floor((y + 5) / 5e-1) AS BIGINT) AS cy FROM ps), range(-3, 4) dx(v), range(-3, 4) dy(v)
WHERE cos(yaw) * ((cx + dx.v + 5e-1) * 5e-1 - x) + sin(yaw) * (-5 + (cy + dy.v + 5e-1) * 5e-1 - y) BETWEEN {-(0.3 - 0.05 + _SM)!r} AND {0.6 - 0.05 + _SM!r}
 AND abs(cos(yaw) * (-5 + (cy + dy.v + 5e-1) * 5e-1 - y) - sin(yaw) * ((cx + dx.v + 5e-1) * 5e-1 - x)) <= {0.25 - 0.05 + _SM!r}
 AND cx + dx.v BETWEEN 0 AND 149 AND cy + dy.v BETWEEN 0 AND 19""",
)
def _(spark, d):
    line = clean_line(spark, d)
    return ce.sweep_footprint(line, fixed_grid(line), 0.5, "rectangle", 0.6, 0.3, 0.5, 0.05)


DISK = SWEEP.format(radius="0e0") + f""",
sw AS (SELECT DISTINCT run_id, cx + dx.v AS cx, cy + dy.v AS cy FROM
 (SELECT *, CAST(floor(x / 5e-1) AS BIGINT) AS cx, CAST(floor((y + 5) / 5e-1) AS BIGINT) AS cy FROM ps), range(-2, 3) dx(v), range(-2, 3) dy(v)
 WHERE ((cx + dx.v + 5e-1) * 5e-1 - x)**2 + (-5 + (cy + dy.v + 5e-1) * 5e-1 - y)**2 <= {0.4 - 0.05 + _SM!r}**2 + 1e-12
 AND cx BETWEEN 0 AND 149 AND cx + dx.v BETWEEN 0 AND 149 AND cy + dy.v BETWEEN 0 AND 19)"""


def swept_cells(spark, d):
    line = clean_line(spark, d)
    return ce.sweep_footprint(line, fixed_grid(line), 0.5, "circle", 0.0, 0.0, 0.8, 0.05)


@query("j11_sweep_disk", DISK + " SELECT * FROM sw")
def _(spark, d):
    return swept_cells(spark, d)


SWEPT = SUPPORT.replace("WITH ", DISK + ", ", 1) + """,
fin AS (SELECT coalesce(c.run_id, s.run_id) AS run_id, coalesce(c.cx, s.cx) AS cx, coalesce(c.cy, s.cy) AS cy,
  coalesce(obstacle, FALSE) AND s.run_id IS NULL AS obstacle, coalesce(observed_free, FALSE) OR s.run_id IS NOT NULL AS observed_free,
  coalesce(unknown, TRUE) AND s.run_id IS NULL AS unknown, coalesce(obstacle, FALSE) AND s.run_id IS NOT NULL AS cleared,
  coalesce(low_support, FALSE) AS low_support
  FROM cls c FULL JOIN sw s ON s.run_id = c.run_id AND s.cx = c.cx AND s.cy = c.cy)"""


@query("x1_combined_free_space", SWEPT + " SELECT * FROM fin")
def _(spark, d):
    return ce.apply_sweep(classes(spark, d), swept_cells(spark, d))


@query(
    "a8_obstacle_points",
    SWEPT + """ SELECT h.run_id, count(*) AS n, CAST(sum(observation_count) AS BIGINT) AS obs FROM hz h JOIN fin f ON f.run_id = h.run_id AND f.cx = h.cx AND f.cy = h.cy AND f.obstacle
WHERE hgt BETWEEN 12e-2 AND 12e-1 GROUP BY h.run_id""",
)
def _(spark, d):
    p, grid, pc = fixed_cells(spark, d)
    cand = ce.height_above_ground(pc, ground_cells(pc)).filter(F.col("height").between(*BAND))
    fin = ce.apply_sweep(classes(spark, d), swept_cells(spark, d))
    return ce.obstacle_points(cand, fin).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("observation_count").alias("obs"))


LATTICE = """, lat AS (SELECT run_id, x.v AS cx, y.v AS cy FROM (SELECT DISTINCT run_id FROM cls), range(0, 150) x(v), range(0, 20) y(v))"""


@query(
    "k8_trinary_cells",
    SUPPORT + LATTICE + """ SELECT lat.*, CAST(CASE WHEN obstacle THEN 0 WHEN unknown THEN 205 WHEN observed_free THEN 254 ELSE 205 END AS INTEGER) AS pixel
FROM lat LEFT JOIN cls USING (run_id, cx, cy)""",
)
def _(spark, d):
    return ce.to_trinary_cells(classes(spark, d), fixed_grid(view(spark, d, "points_v")))


@query(
    "k9_binary_mask",
    SUPPORT + LATTICE + """ SELECT lat.*, CAST(CASE WHEN obstacle THEN 0 ELSE 254 END AS INTEGER) AS pixel FROM lat LEFT JOIN cls USING (run_id, cx, cy)""",
)
def _(spark, d):
    return ce.to_binary_mask(classes(spark, d).filter("obstacle"), fixed_grid(view(spark, d, "points_v")))
