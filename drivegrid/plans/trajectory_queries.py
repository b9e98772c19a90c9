"""Queries over pose tables, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivegrid.functions import vec as V
from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.operators import trajectory as tr
from drivegrid.plans.registry import query
from drivegrid.plans.tables import view, with_views

POSES = with_views("poses_v")
# ordered poses of each run, one per stamp
LINE = POSES + """,
line AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) - 1 AS i FROM
  (SELECT *, row_number() OVER (PARTITION BY run_id, stamp_ns ORDER BY seq DESC) AS rn FROM poses_v)
  WHERE rn = 1)"""


def q(name: str, digits: int = 6):
    return quantize(F.col(name), digits).alias(name)


def clean_line(spark, d):
    return tr.normalize_trajectory(view(spark, d, "poses_v"))


@query(
    "f23_drop_invalid_poses",
    POSES + f"""
SELECT run_id, seq, {Q('qx / n', 9)} AS qx, {Q('qz / n', 9)} AS qz, {Q('qw / n', 9)} AS qw
FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM
  (SELECT run_id, seq, CASE WHEN seq % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x,
     CASE WHEN seq % 5 = 0 THEN 0e0 ELSE qx END AS qx, CASE WHEN seq % 5 = 0 THEN 0e0 ELSE qy END AS qy,
     CASE WHEN seq % 5 = 0 THEN 0e0 ELSE qz END AS qz, CASE WHEN seq % 5 = 0 THEN 0e0 ELSE qw END AS qw
   FROM poses_v) p)
WHERE NOT isnan(x) AND n * n >= 1e-15""",
)
def _(spark, d):
    p = view(spark, d, "poses_v")
    zero = {c: F.when(F.col("seq") % 5 == 0, 0.0).otherwise(F.col(c)) for c in ("qx", "qy", "qz", "qw")}
    p = p.withColumns({**zero, "x": F.when(F.col("seq") % 11 == 0, float("nan")).otherwise(F.col("x"))})
    return tr.drop_invalid_poses(p).select("run_id", "seq", q("qx", 9), q("qz", 9), q("qw", 9))


@query(
    "w2_dedupe_poses",
    POSES + f"""
SELECT run_id, stamp_ns, seq, {Q('x')} AS x, {Q('y')} AS y FROM
 (SELECT *, row_number() OVER (PARTITION BY run_id, stamp_ns ORDER BY seq DESC) AS rn FROM
   (SELECT run_id, seq, x, y, stamp_ns - stamp_ns % 7200000000000 AS stamp_ns FROM poses_v))
WHERE rn = 1""",
)
def _(spark, d):
    p = view(spark, d, "poses_v").withColumn("stamp_ns", F.expr("stamp_ns - stamp_ns % 7200000000000"))
    return tr.dedupe_poses(p).select("run_id", "stamp_ns", "seq", q("x"), q("y"))


@query("t1_order_poses", LINE + " SELECT run_id, i, seq, stamp_ns FROM line")
def _(spark, d):
    return clean_line(spark, d).select("run_id", "i", "seq", "stamp_ns")


@query(
    "w1_arc_length",
    LINE + f"""
SELECT run_id, i, {Q('sum(step) OVER (PARTITION BY run_id ORDER BY i)')} AS s FROM
 (SELECT run_id, i, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2
   + (z - lag(z) OVER w)**2), 0) AS step FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i))""",
)
def _(spark, d):
    return tr.arc_length(clean_line(spark, d)).select("run_id", "i", q("s"))


@query(
    "a11_polyline_length",
    LINE + f"""
SELECT run_id, {Q('sum(d2)')} AS length_2d, {Q('sum(d3)')} AS length_3d, count(*) AS points FROM
 (SELECT run_id, coalesce(hypot2, 0) AS d2, coalesce(sqrt(hypot2*hypot2 + dz*dz), 0) AS d3 FROM
  (SELECT run_id, z - lag(z) OVER w AS dz,
     sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS hypot2
   FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i)))
GROUP BY run_id""",
)
def _(spark, d):
    return tr.polyline_length(clean_line(spark, d)).select("run_id", q("length_2d"), q("length_3d"), "points")


SEGMENTS = LINE + """,
stepped AS (SELECT run_id, i, x, y, z, stamp_ns,
   sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS d,
   (stamp_ns - lag(stamp_ns) OVER w) * 1e-9 AS dt
  FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i)),
flagged AS (SELECT *, CASE WHEN d > 45e-2 OR (CASE WHEN dt > 1e-9 THEN d / dt ELSE 'inf'::DOUBLE END) > 2e-2
   THEN 1 ELSE 0 END AS brk FROM stepped),
seg AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY run_id ORDER BY i) AS BIGINT) AS segment FROM flagged),
summary AS (SELECT run_id, segment, sum(CASE WHEN brk = 1 THEN 0 ELSE coalesce(d, 0) END) AS length,
   count(*) AS poses, min(i) AS first_i, max(i) AS last_i FROM seg GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY floor(length * 1e9 + 5e-1) DESC, poses DESC, segment) AS rn,
   count(*) OVER (PARTITION BY run_id) - 1 AS discarded_segments FROM summary)
"""
JUMP, SPEED = 0.45, 0.02


@query(
    "w3_longest_segment",
    SEGMENTS + f"""SELECT run_id, segment, {Q('length')} AS length, poses, first_i, last_i, discarded_segments
FROM best WHERE rn = 1""",
)
def _(spark, d):
    seg = tr.split_segments(clean_line(spark, d), JUMP, SPEED)
    return tr.pick_segment(tr.segment_summary(seg)).select(
        "run_id", "segment", q("length"), "poses", "first_i", "last_i", "discarded_segments"
    )


@query(
    "w3_longest_segment_poses",
    SEGMENTS + f"""SELECT s.run_id, s.i - b.first_i AS i, s.stamp_ns, {Q('s.x')} AS x FROM seg s
JOIN best b ON b.run_id = s.run_id AND b.segment = s.segment AND b.rn = 1""",
)
def _(spark, d):
    return tr.longest_segment(clean_line(spark, d), JUMP, SPEED).select("run_id", "i", "stamp_ns", q("x"))


@query(
    "f24_remove_stationary",
    # sequential by nature: one recursive step per kept pose
    POSES.replace("WITH ", "WITH RECURSIVE ", 1) + LINE[len(POSES):] + """,
kept AS (SELECT run_id, i, x, y, z FROM line WHERE i = 0
 UNION ALL SELECT n.run_id, n.i, n.x, n.y, n.z FROM kept k, LATERAL
  (SELECT l.run_id, l.i, l.x, l.y, l.z FROM line l WHERE l.run_id = k.run_id AND l.i > k.i AND
    sqrt((l.x-k.x)**2 + (l.y-k.y)**2 + (l.z-k.z)**2) >= 15e-1 ORDER BY l.i LIMIT 1) n),
both_ AS (SELECT run_id, i FROM kept UNION SELECT run_id, max(i) FROM line GROUP BY run_id)
SELECT l.run_id, l.seq, row_number() OVER (PARTITION BY l.run_id ORDER BY l.i) - 1 AS i
FROM line l JOIN both_ b ON b.run_id = l.run_id AND b.i = l.i""",
)
def _(spark, d):
    return tr.remove_stationary(clean_line(spark, d), 1.5).select("run_id", "seq", "i")


@query(
    "w4_resample",
    LINE + f""",
step AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2), 0) AS d
  FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i)),
arc AS (SELECT *, sum(d) OVER (PARTITION BY run_id ORDER BY i) AS s FROM step),
seg AS (SELECT *, lead(s) OVER w AS s1, lead(stamp_ns) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1,
  lead(z) OVER w AS z1 FROM arc WINDOW w AS (PARTITION BY run_id ORDER BY i)),
tot AS (SELECT run_id, max(s) AS total, max_by(stamp_ns, i) AS te, max_by(x, i) AS xe, max_by(y, i) AS ye, max_by(z, i) AS ze FROM arc GROUP BY run_id),
k AS (SELECT run_id, unnest(range(0, CAST(ceil(total / 75e-2) AS BIGINT))) AS k, total FROM tot),
pick AS (SELECT k.run_id, k.k, k.k * 75e-2 AS target, min(s.i) AS right_i FROM k JOIN arc s ON s.run_id = k.run_id AND s.i >= 1 AND s.s >= k.k * 75e-2
  WHERE k.k * 75e-2 < k.total GROUP BY 1, 2, 3),
smp AS (SELECT p.run_id, p.k AS i, stamp_ns + CAST(floor(r * (t1 - stamp_ns) + 5e-1) AS BIGINT) AS stamp_ns, x + (x1 - x) * r AS x, y + (y1 - y) * r AS y, z + (z1 - z) * r AS z
  FROM (SELECT p.*, g.*, (target - s) / (s1 - s) AS r FROM pick p JOIN seg g ON g.run_id = p.run_id AND g.i = p.right_i - 1) p),
fin AS (SELECT * FROM smp UNION ALL SELECT run_id, n + 1, te, xe, ye, ze FROM
  (SELECT run_id, max(i) AS n, max_by(x, i) AS lx, max_by(y, i) AS ly, max_by(z, i) AS lz FROM smp GROUP BY run_id) l JOIN tot USING (run_id)
  WHERE sqrt((lx-xe)**2 + (ly-ye)**2 + (lz-ze)**2) > 1e-6)
SELECT run_id, i, CAST(floor(stamp_ns / 1e6) AS BIGINT) AS stamp_ms, {Q('x')} AS x, {Q('y')} AS y, {Q('z')} AS z FROM fin""",
)
def _(spark, d):
    out = tr.resample(clean_line(spark, d), 0.75)
    return out.select("run_id", "i", F.floor(F.col("stamp_ns") / F.lit(1e6)).alias("stamp_ms"), q("x"), q("y"), q("z"))


# a path with sideways pairs: rows 8k+3, 8k+4 swap across the lane; heading along x
JITTER = LINE.replace("SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) - 1 AS i",
                      "SELECT run_id, seq, stamp_ns, z, x, y, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) - 1 AS i") + """,
jl AS (SELECT run_id, i, stamp_ns, z, i * 2e-1 + CASE i % 8 WHEN 3 THEN 15e-2 WHEN 4 THEN -15e-2 ELSE 0e0 END AS x,
  CASE i % 8 WHEN 3 THEN 1e-1 WHEN 4 THEN -1e-1 ELSE 0e0 END + y * 1e-2 AS y FROM line)
"""


def jitter_line(spark, d):
    i = F.col("i")
    p = clean_line(spark, d)
    bump = lambda a: F.when(i % 8 == 3, a).when(i % 8 == 4, -a).otherwise(0.0)
    return p.withColumns({
        "x": i * 0.2 + bump(0.15), "y": bump(0.1) + F.col("y") * 1e-2,
        "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.lit(1.0),
    })


JIT_FIX = JITTER.replace("WITH ", "WITH RECURSIVE ", 1) + """,
nb AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(stamp_ns) OVER w AS pt, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
  lead(stamp_ns) OVER w AS nt, lead(x, 2) OVER w AS ax, lead(y, 2) OVER w AS ay, lead(stamp_ns, 2) OVER w AS at_
  FROM jl WINDOW w AS (PARTITION BY run_id ORDER BY i)),
hd AS (SELECT *, degrees(atan2(y - py, x - px)) AS h1, degrees(atan2(ny - y, nx - x)) AS h2, degrees(atan2(ay - ny, ax - nx)) AS h3,
  sqrt((nx-x)**2 + (ny-y)**2) AS mid FROM nb WHERE px IS NOT NULL AND ax IS NOT NULL),
df AS (SELECT *, least(abs(h2 - h1), 360 - abs(h2 - h1)) AS d1, least(abs(h3 - h2), 360 - abs(h3 - h2)) AS d2,
  least(abs(h3 - h1), 360 - abs(h3 - h1)) AS d3, least(abs(h1), 180 - abs(h1)) AS e1, least(abs(h3), 180 - abs(h3)) AS e3,
  least(abs(h2), 180 - abs(h2)) AS e2 FROM hd),
cand AS (SELECT * FROM df WHERE mid > 1e-9 AND mid <= 5e-1 AND d1 >= 90 AND d2 >= 90 AND d3 <= 45 AND e1 <= 30 AND e3 <= 30 AND e2 > 45),
pick AS (SELECT run_id, min(i) AS i FROM cand GROUP BY run_id UNION ALL
  SELECT p.run_id, n.i FROM pick p, LATERAL (SELECT min(c.i) AS i FROM cand c WHERE c.run_id = p.run_id AND c.i >= p.i + 3) n WHERE n.i IS NOT NULL),
sel AS (SELECT c.* FROM cand c JOIN pick p ON p.run_id = c.run_id AND p.i = c.i),
fix AS (SELECT run_id, i, px + (ax - px) * (stamp_ns - pt) / (at_ - pt)::DOUBLE AS fx, py + (ay - py) * (stamp_ns - pt) / (at_ - pt)::DOUBLE AS fy FROM sel
  UNION ALL SELECT run_id, i + 1, px + (ax - px) * (nt - pt) / (at_ - pt)::DOUBLE, py + (ay - py) * (nt - pt) / (at_ - pt)::DOUBLE FROM sel),
res AS (SELECT j.run_id, j.i, coalesce(fx, x) AS x, coalesce(fy, y) AS y, fx IS NOT NULL AS corrected, sqrt((fx-x)**2 + (fy-y)**2) AS moved FROM jl j LEFT JOIN fix f ON f.run_id = j.run_id AND f.i = j.i)
"""


@query("w5_fix_position_jitter", JIT_FIX + f"SELECT run_id, i, {Q('x')} AS x, {Q('y')} AS y, corrected FROM res")
def _(spark, d):
    return tr.fix_position_jitter(jitter_line(spark, d)).select("run_id", "i", q("x"), q("y"), "corrected")


@query(
    "w5_jitter_audit",
    JIT_FIX + f""",
l0 AS (SELECT run_id, sum(d) AS l FROM (SELECT run_id, sqrt((x-lag(x) OVER w)**2 + (y-lag(y) OVER w)**2) AS d FROM jl WINDOW w AS (PARTITION BY run_id ORDER BY i)) GROUP BY 1),
l1 AS (SELECT run_id, sum(d) AS l FROM (SELECT run_id, sqrt((x-lag(x) OVER w)**2 + (y-lag(y) OVER w)**2) AS d FROM res WINDOW w AS (PARTITION BY run_id ORDER BY i)) GROUP BY 1)
SELECT r.run_id, {Q('any_value(l0.l)')} AS length_before, {Q('any_value(l1.l)')} AS length_after, count(*) FILTER (corrected) AS corrected_poses,
 count(*) FILTER (corrected) // 2 AS corrected_runs, {Q('coalesce(max(moved), 0)')} AS max_correction
FROM res r JOIN l0 USING (run_id) JOIN l1 USING (run_id) GROUP BY r.run_id""",
)
def _(spark, d):
    line = jitter_line(spark, d)
    out = tr.jitter_audit(line, tr.fix_position_jitter(line))
    return out.select("run_id", q("length_before"), q("length_after"), "corrected_poses", "corrected_runs", q("max_correction"))


@query(
    "w7_smooth_positions",
    LINE + f""",
nb AS (SELECT run_id, i, x, y, z, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
  count(*) OVER (PARTITION BY run_id) AS n FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i)),
tn AS (SELECT *, CASE WHEN abs(px) + abs(nx) IS NULL THEN FALSE ELSE
   acos(greatest(-1e0, least(1e0, ((x-px)*(nx-x) + (y-py)*(ny-y)) / (sqrt((x-px)**2+(y-py)**2) * sqrt((nx-x)**2+(ny-y)**2))))) >= radians(90) END AS sharp FROM nb),
fr AS (SELECT a.run_id, a.i, a.x, a.y, a.z, a.n, a.sharp,
  greatest(a.i - 3, 0, coalesce((SELECT max(b.i) FROM tn b WHERE b.run_id = a.run_id AND b.sharp AND b.i BETWEEN a.i - 3 AND a.i - 1), 0)) AS lo,
  least(a.i + 3, a.n - 1, coalesce((SELECT min(b.i) FROM tn b WHERE b.run_id = a.run_id AND b.sharp AND b.i BETWEEN a.i + 1 AND a.i + 3), a.n)) AS hi FROM tn a)
SELECT f.run_id, f.i, {Q('CASE WHEN any_value(f.sharp) OR f.i = 0 OR f.i = any_value(f.n) - 1 THEN any_value(f.x) ELSE avg(t.x) END')} AS x,
 {Q('CASE WHEN any_value(f.sharp) OR f.i = 0 OR f.i = any_value(f.n) - 1 THEN any_value(f.y) ELSE avg(t.y) END')} AS y
FROM fr f JOIN tn t ON t.run_id = f.run_id AND t.i BETWEEN f.lo AND f.hi GROUP BY f.run_id, f.i""",
)
def _(spark, d):
    return tr.smooth_positions(clean_line(spark, d), 1.2, 0.2).select("run_id", "i", q("x"), q("y"))


@query(
    "w14_yaw_range",
    LINE + f""",
yw AS (SELECT run_id, i, atan2(2 * (qw*qz + qx*qy) / n, 1 - 2 * (qy*qy + qz*qz) / n) AS yaw FROM (SELECT *, qx*qx+qy*qy+qz*qz+qw*qw AS n FROM line)),
st AS (SELECT run_id, i, coalesce(atan2(sin(yaw - lag(yaw) OVER w), cos(yaw - lag(yaw) OVER w)), yaw) AS s FROM yw WINDOW w AS (PARTITION BY run_id ORDER BY i)),
un AS (SELECT run_id, sum(s) OVER (PARTITION BY run_id ORDER BY i) AS u FROM st)
SELECT run_id, {Q('max(u) - min(u)')} AS yaw_range FROM un GROUP BY run_id""",
)
def _(spark, d):
    return tr.yaw_range(clean_line(spark, d)).select("run_id", q("yaw_range"))
