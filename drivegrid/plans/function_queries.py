"""Scalar expressions exercised over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from drivegrid.functions import evidence as ev
from drivegrid.functions import frames, geom2d as G, num, vec as V
from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.plans.registry import query
from drivegrid.plans.tables import table, view, with_views

P = with_views("poses_v")
S = with_views("samples_v")


def out(**cols):
    return [quantize(c).alias(n) for n, c in cols.items()]


@query("f2_vector_algebra", P + f""" SELECT seq, {Q('x*y + y*z + z*x')} AS dot, {Q('sqrt(x*x + y*y + z*z)')} AS norm, {Q('x / sqrt(x*x + y*y + z*z)')} AS ux,
 {Q('sqrt((x-y)**2 + (y-z)**2)')} AS d2, {Q('sqrt((x-y)**2 + (y-z)**2 + (z-x)**2)')} AS d3, {Q('least(greatest(x, 1), 2)')} AS clamped FROM poses_v""")
def _(spark, d):
    a = V.vec()
    b = (F.col("y"), F.col("z"), F.col("x"))
    return view(spark, d, "poses_v").select("seq", *out(
        dot=V.dot(a, b), norm=V.norm(a), ux=V.normalized(a)[0], d2=V.dist2(a[0], a[1], b[0], b[1]), d3=V.dist3(a, b), clamped=num.clamp(a[0], 1.0, 2.0)))


@query("f3_angles", P + f""" SELECT seq, {Q('atan2(sin(x), cos(x))')} AS wrapped, {Q('least(abs(atan2(sin(x - y), cos(x - y))), abs(pi() - abs(atan2(sin(x - y), cos(x - y)))))')} AS undirected FROM poses_v""")
def _(spark, d):
    x, y, _ = V.vec()
    return view(spark, d, "poses_v").select("seq", *out(wrapped=V.normalize_angle(x), undirected=V.undirected_heading_diff(x, y)))


@query("f4_quaternions", P + f""", n AS (SELECT seq, qx/n AS a, qy/n AS b, qz/n AS c, qw/n AS w, x, y, z FROM (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS n FROM poses_v))
SELECT seq, {Q('(1 - 2*(b*b + c*c))*x + 2*(a*b - w*c)*y + 2*(a*c + w*b)*z')} AS rx, {Q('2*(a*b + w*c)*x + (1 - 2*(a*a + c*c))*y + 2*(b*c - w*a)*z')} AS ry,
 {Q('atan2(2*(w*c + a*b), 1 - 2*(b*b + c*c))')} AS yaw, {Q('-a')} AS inv_x, {Q('w*a + a*w')} AS sq_x FROM n""")
def _(spark, d):
    p = frames.rotate(frames.unit(view(spark, d, "poses_v")), "", ("x", "y", "z"), ("rx", "ry", "rz"))
    q = V.quat()
    return p.select("seq", *out(rx=F.col("rx"), ry=F.col("ry"), yaw=V.q_yaw_unit(q), inv_x=V.q_inverse(q)[0], sq_x=V.q_mul(q, q)[0]))


@query("f5_slerp", P + f""" SELECT seq, {Q('sin(h * 3e-1)')} AS qz, {Q('cos(h * 3e-1)')} AS qw FROM (SELECT seq, (y - 1) AS h FROM poses_v)""")
def _(spark, d):
    # from the identity to a yaw of 2 (y - 1): three tenths of the way
    half = F.col("y") - 1
    p = view(spark, d, "poses_v").select("seq", *[F.lit(v).alias(f"a_{n}") for v, n in zip(frames.IDENTITY, frames.PARTS)],
                                         *[F.lit(0.0).alias(f"b_{n}") for n in ("x", "y", "z", "qx", "qy")], F.sin(half).alias("b_qz"), F.cos(half).alias("b_qw"))
    p = frames.interpolate(p, "a_", "b_", F.lit(0.3), "o_")
    return p.select("seq", *out(qz=F.col("o_qz"), qw=F.col("o_qw")))


@query("f6_transform_round_trip", P + f""" SELECT seq, {Q('y')} AS px, {Q('z')} AS py, {Q('x')} AS pz FROM poses_v""")
def _(spark, d):
    # applying a transform and then its inverse gives the point back
    p = frames.unit(view(spark, d, "poses_v")).withColumns({"p1": F.col("y"), "p2": F.col("z"), "p3": F.col("x")})
    p = frames.invert(frames.apply(p, "", ("p1", "p2", "p3"), ("w1", "w2", "w3")), "", "i_")
    p = frames.apply(p, "i_", ("w1", "w2", "w3"), ("b1", "b2", "b3"))
    return p.select("seq", *out(px=F.col("b1"), py=F.col("b2"), pz=F.col("b3")))


@query("f8_cell_keys", P + f""" SELECT seq, CAST(floor((x + 3) / 25e-2) AS BIGINT) AS cx, {Q('-3 + (floor((x + 3) / 25e-2) + 5e-1) * 25e-2')} AS center FROM poses_v""")
def _(spark, d):
    p = view(spark, d, "poses_v").withColumn("cx", G.cell_of(F.col("x"), -3.0, 0.25))
    return p.select("seq", "cx", *out(center=G.cell_center(F.col("cx"), -3.0, 0.25)))


TRI = S + """, t AS (SELECT edge_id, i, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM samples_v WINDOW w AS (PARTITION BY edge_id ORDER BY i))"""


def triples(spark, d):
    from drivegrid.lib.ordered import measured, with_neighbours

    s = with_neighbours(measured(view(spark, d, "samples_v")), ["run_id", "edge_id"], "i", ["x", "y"], back=0, ahead=2).filter("x_n2 IS NOT NULL")
    c = F.col
    return s, (c("x"), c("y")), (c("x_n1"), c("y_n1")), (c("x_n2"), c("y_n2"))


@query("f11_menger_curvature", TRI + f""" SELECT edge_id, i, {Q('2 * abs((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax)) / (sqrt((bx-ax)**2+(by_-ay)**2) * sqrt((cx-bx)**2+(cy-by_)**2) * sqrt((cx-ax)**2+(cy-ay)**2))', 4)} AS k FROM t WHERE cx IS NOT NULL""")
def _(spark, d):
    s, a, b, c = triples(spark, d)
    return s.select("edge_id", "i", quantize(G.menger_curvature(a, b, c), 4).alias("k"))


@query("f12_project_on_segment", TRI + f""", r AS (SELECT *, least(1, greatest(0, ((bx-ax)*(cx-ax) + (by_-ay)*(cy-ay)) / ((cx-ax)**2 + (cy-ay)**2))) AS r FROM t WHERE cx IS NOT NULL)
SELECT edge_id, i, {Q('r')} AS ratio, {Q('sqrt((ax + (cx-ax)*r - bx)**2 + (ay + (cy-ay)*r - by_)**2)')} AS distance FROM r""")
def _(spark, d):
    s, a, b, c = triples(spark, d)
    r, _, _, dist = G.project(a, c, b)
    return s.select("edge_id", "i", *out(ratio=r, distance=dist))


@query("f13_segment_predicates", TRI + """, u AS (SELECT *, ax + 5e-1 AS px, ay - 1 AS py, ax + 4e-1 AS qx, ay + 1 AS qy FROM t WHERE cx IS NOT NULL),
o AS (SELECT *, (bx-ax)*(py-ay) - (by_-ay)*(px-ax) AS o1, (bx-ax)*(qy-ay) - (by_-ay)*(qx-ax) AS o2, (qx-px)*(ay-py) - (qy-py)*(ax-px) AS o3, (qx-px)*(by_-py) - (qy-py)*(bx-px) AS o4, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS turn FROM u)
SELECT edge_id, i, CAST(sign(turn) AS INTEGER) AS side, o1 * o2 < 0 AND o3 * o4 < 0 AS crosses FROM o""")
def _(spark, d):
    s, a, b, c = triples(spark, d)
    p, q = (a[0] + 0.5, a[1] - 1), (a[0] + 0.4, a[1] + 1)
    return s.select("edge_id", "i", G.orientation(a, b, c).alias("side"), G.segments_intersect(a, b, p, q).alias("crosses"))


@query("f14_segment_hits_cell", TRI + """, s AS (SELECT edge_id, i, ax, ay, bx, by_, floor(ax / 25e-2) * 25e-2 + 25e-2 AS x0, floor(ay / 25e-2) * 25e-2 AS y0 FROM t WHERE cx IS NOT NULL)
SELECT edge_id, i, greatest(0, least((x0-ax)/(bx-ax), (x0+25e-2-ax)/(bx-ax)), least((y0-ay)/(by_-ay), (y0+25e-2-ay)/(by_-ay))) <= least(1, greatest((x0-ax)/(bx-ax), (x0+25e-2-ax)/(bx-ax)), greatest((y0-ay)/(by_-ay), (y0+25e-2-ay)/(by_-ay))) + 1e-12 AS hit FROM s""")
def _(spark, d):
    s, a, b, _ = triples(spark, d)
    s = s.withColumns({"cx": G.cell_of(F.col("x"), 0.0, 0.25) + 1, "cy": G.cell_of(F.col("y"), 0.0, 0.25)})
    return s.select("edge_id", "i", G.segment_hits_cell(a, b, F.col("cx"), F.col("cy"), 0.0, 0.0, 0.25).alias("hit"))


@query("f15_body_hits_cell", S + """, c AS (SELECT edge_id, i, i * 1e-1 AS yaw, x * 37e-2 - 3 AS gx, y * 5e-1 - 2 AS gy FROM samples_v),
b AS (SELECT *, gx - cos(yaw) * 5e-1 AS dx, gy - sin(yaw) * 5e-1 AS dy FROM c)
SELECT edge_id, i, abs(cos(yaw)*dx + sin(yaw)*dy) <= 1 + 25e-2*(abs(cos(yaw)) + abs(sin(yaw))) AND abs(cos(yaw)*dy - sin(yaw)*dx) <= 6e-1 + 25e-2*(abs(cos(yaw)) + abs(sin(yaw)))
 AND abs(dx) <= 25e-2 + abs(cos(yaw)) + 6e-1*abs(sin(yaw)) AND abs(dy) <= 25e-2 + abs(sin(yaw)) + 6e-1*abs(cos(yaw)) AS body,
 greatest(0, abs(gx) - 25e-2)**2 + greatest(0, abs(gy) - 25e-2)**2 <= 81e-2 AS disk FROM b""")
def _(spark, d):
    s = view(spark, d, "samples_v").withColumns({"gx": F.col("x") * 0.37 - 3, "gy": F.col("y") * 0.5 - 2, "yaw": F.col("i") * 0.1})
    z = F.lit(0.0)
    return s.select("edge_id", "i", G.rectangle_hits_cell(z, z, F.col("yaw"), 1.5, 0.5, 0.6, F.col("gx"), F.col("gy"), 0.5).alias("body"),
                    G.circle_hits_cell(z, z, 0.9, F.col("gx"), F.col("gy"), 0.5).alias("disk"))


@query("f16_speed_text", f"""SELECT p_partkey, {Q("CASE p_partkey % 5 WHEN 0 THEN p_size / 36e-1 WHEN 1 THEN p_size / 36e-1 WHEN 2 THEN p_size * 44704e-5 WHEN 3 THEN CAST(p_size AS DOUBLE) END")} AS mps FROM part""")
def _(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" KM/h"))).when(k == 2, F.concat(n, F.lit("mph"))).when(k == 3, F.concat(n, F.lit(".0 m/s"))).otherwise(F.concat(n, F.lit(" knots")))
    return table(spark, d, "part").select("p_partkey", quantize(ev.speed_mps(text)).alias("mps"))


EVID = """WITH e AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'measured' WHEN 2 THEN 'catalog_estimated' WHEN 3 THEN 'inferred' ELSE 'guess' END AS s, CASE o_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS c FROM orders)"""


def evid(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey") % 4
    return table(spark, d, "orders").withColumns({
        "s": F.when(k == 0, "unknown").when(k == 1, "measured").when(k == 2, "catalog_estimated").when(k == 3, "inferred").otherwise("guess"),
        "c": F.when(c == 0, "unknown").when(c == 1, "low").when(c == 2, "medium").otherwise("high")})


@query("f17_evidence", EVID + """ SELECT o_orderkey, s <> 'guess' AS valid, s IN ('measured', 'catalog_estimated', 'inferred') AND c IN ('medium', 'high') AS closed_course, s = 'measured' AND c = 'high' AS production FROM e""")
def _(spark, d):
    s, c = F.col("s"), F.col("c")
    return evid(spark, d).select("o_orderkey", ev.valid_evidence(s, c).alias("valid"), ev.closed_course_ok(s, c).alias("closed_course"), ev.production_ok(s, c).alias("production"))


@query("f18_reason_codes", EVID + """ SELECT o_orderkey, concat_ws(',', CASE WHEN s = 'guess' THEN 'source_invalid' END, CASE WHEN c IN ('unknown', 'low') THEN 'confidence_low' END) AS codes FROM e""")
def _(spark, d):
    codes = num.reason_codes((F.col("s") == "guess", "source_invalid"), (F.col("c") == "low", "confidence_low"), (F.col("c") == "unknown", "confidence_low"))
    return evid(spark, d).select("o_orderkey", F.array_join(codes, ",").alias("codes"))


@query("f19_recommended_speed", P + f""" SELECT seq, {Q('greatest(1e-1, 15e-1 / (1 + 3 * x))')} AS speed FROM poses_v""")
def _(spark, d):
    return view(spark, d, "poses_v").select("seq", *out(speed=ev.recommended_speed(F.lit(1.5), F.col("x"))))


@query("f21_parameter_ranges", """SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size > 10 THEN 'size_not_above_10' END, CASE WHEN p_retailprice < 901 OR p_retailprice > 950 THEN 'price_out_of_range' END) AS codes FROM part""")
def _(spark, d):
    codes = num.reason_codes((~(F.col("p_size") > 10), "size_not_above_10"), (~F.col("p_retailprice").between(901, 950), "price_out_of_range"))
    return table(spark, d, "part").select("p_partkey", F.array_join(codes, ",").alias("codes"))
