"""Queries for validation gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize_sql as Q
from drivegrid.operators import graph as gr
from drivegrid.operators import polylines as pl
from drivegrid.operators import quality as qu
from drivegrid.plans.graph_queries import LINKS, links
from drivegrid.plans.interval_queries import BASE, arcs3, edges3, spans
from drivegrid.plans.polyline_queries import lines
from drivegrid.plans.registry import query
from drivegrid.plans.spatial_queries import ARC2, HEX, hexagons
from drivegrid.plans.tables import table, view, with_views


@query("v2_edge_status", LINKS + """, e AS (SELECT *, CASE WHEN edge_id % 7 = 0 THEN 'unknown_clearance' END AS c0, CASE WHEN length > 40 THEN 'edge_above_maximum_length' END AS c1, CASE WHEN edge_id % 11 = 0 THEN 'vehicle_footprint_overlaps_unknown' END AS c2, CASE WHEN edge_id % 13 = 5 THEN 'minimum_turning_radius_violation' END AS c3 FROM links_v)
SELECT edge_id, concat_ws(',', c0, c1, c2, c3) AS errors, CASE WHEN NOT passable OR c1 IS NOT NULL OR c2 IS NOT NULL OR c3 IS NOT NULL THEN 'INVALID' WHEN c0 IS NOT NULL THEN 'WARNING' ELSE 'VALID' END AS status FROM e""")
def _(spark, d):
    i = F.col("edge_id")
    e = links(spark, d).withColumns({
        "errors": F.when(i % 7 == 0, F.array(F.lit("unknown_clearance"))).otherwise(F.array().cast("array<string>")), "hits_unknown": i % 11 == 0, "hits_obstacle": F.lit(False),
        "max_curvature": F.when(i % 13 == 5, 0.5).otherwise(0.1), "tangent_reversal": F.lit(False), "reverse_direction": F.lit(False)})
    return qu.edge_status(e, min_length=0.0, max_length=40.0, min_turning_radius=4.0).select("edge_id", F.array_join("errors", ",").alias("errors"), "status")


@query("v3_check_semantics", BASE + """, f AS (SELECT run_id, feature_id, type, CASE WHEN feature_id % 17 = 3 THEN -1e0 ELSE value END AS value, edge_id, start_s, end_s FROM sp)
SELECT run_id, feature_id, 'value_not_positive' AS code FROM f WHERE type = 'speed_limit' AND value <= 0 UNION ALL SELECT run_id, feature_id, 'feature_id_not_unique_nonzero' FROM f WHERE feature_id = 0
UNION ALL SELECT f.run_id, feature_id, 'span_out_of_range' FROM f JOIN edges USING (run_id, edge_id) WHERE end_s > 6 AND feature_id % 2 = 0""")
def _(spark, d):
    s = spans(spark, d)
    e = edges3(arcs3(spark, d))
    f = s.withColumn("value", F.when(F.col("feature_id") % 17 == 3, -1.0).otherwise(F.col("value")))
    far = s.withColumn("end_s", F.when((F.col("end_s") > 6) & (F.col("feature_id") % 2 == 0), 1e6).otherwise(F.col("end_s")))
    return qu.check_semantics(f, far, e)


V4 = LINKS + """, rt AS (SELECT run_id, from_id AS row, from_id % 180 AS route_id, 'r' || from_id AS name, min_by(from_id, edge_id) AS a, max_by(to_id, edge_id) AS b, count(*) AS n FROM links_v GROUP BY run_id, from_id),
ch AS (SELECT run_id, from_id AS row, from_id, lag(to_id) OVER (PARTITION BY run_id, from_id ORDER BY edge_id) AS p FROM links_v),
br AS (SELECT run_id, row, count(*) FILTER (p <> from_id) AS k FROM ch GROUP BY 1, 2),
c AS (SELECT rt.*, br.k, count(*) OVER (PARTITION BY rt.run_id, route_id) AS ids FROM rt JOIN br USING (run_id, row)), dc AS (SELECT run_id, bool_or(ids > 1) AS void FROM c GROUP BY 1)"""


@query("v4_check_routes", V4 + """ SELECT c.run_id, row, concat_ws(',', CASE WHEN route_id = 0 THEN 'route_id_not_unique_nonzero' END, CASE WHEN k > 0 THEN 'route_edge_chain_disconnected' END, CASE WHEN row % 3 = 1 AND row % 2 = 0 THEN 'promotion_requires_validation_request' END, CASE WHEN ids > 1 THEN 'route_id_duplicate' END, CASE WHEN void THEN 'authoring_document_invalid' END) AS errors FROM c JOIN dc USING (run_id)""")
def _(spark, d):
    e = links(spark, d)
    r = e.groupBy("run_id", F.col("from_id").alias("row")).agg(F.max_by("to_id", "edge_id").alias("end_node_id"))
    row = F.col("row")
    r = r.withColumns({"route_id": row % 180, "name": F.concat(F.lit("r"), row.cast("string")), "start_node_id": row, "validate": row % 2 == 1, "promote": row % 3 == 1})
    re = e.select("run_id", F.col("from_id").alias("row"), F.col("edge_id").alias("pos"), "edge_id")
    nodes = gr.both_ends(e).select("run_id", "node_id").distinct()
    return qu.check_routes(r, re, e, nodes).select("run_id", "row", F.array_join("errors", ",").alias("errors"))


@query("v5_check_stop_lines", BASE + """ SELECT feature_id AS stop_id, concat_ws(',', CASE WHEN feature_id = 0 THEN 'stop_line_id_not_unique_nonzero' END, CASE WHEN feature_id % 6 = 1 THEN 'stop_line_s_out_of_range' END, CASE WHEN feature_id % 5 = 2 AND feature_id % 6 <> 1 THEN 'stop_line_anchor_mismatch' END, CASE WHEN feature_id % 10 = 3 THEN 'stop_line_width_not_positive_finite' END, CASE WHEN edge_id % 8 = 0 THEN 'stop_line_edge_not_in_compatible_route' END) AS errors FROM sp""")
def _(spark, d):
    arc = arcs3(spark, d)
    i = F.col("feature_id")
    s = spans(spark, d).select("run_id", "edge_id", i.alias("stop_id"), F.col("start_s").alias("s"))
    at = pl.sample_at_arc(arc, s.withColumnRenamed("s", "t")).withColumnRenamed("t", "s")
    k = F.col("stop_id")
    st = at.withColumns({"x": F.col("x") + F.when((k % 5 == 2) & (k % 6 != 1), 3.0).otherwise(0.0), "width": F.when(k % 10 == 3, -1.0).otherwise(3.0), "s": F.when(k % 6 == 1, -5.0).otherwise(F.col("s"))})
    on = s.filter("edge_id % 8 <> 0").select("run_id", "edge_id").distinct()
    return qu.check_stop_lines(st, lines(spark, d), on).select("stop_id", F.array_join("errors", ",").alias("errors"))


RUNS = """WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 3 AS a, o_orderkey % 4 AS b, o_orderkey % 5 AS c, o_custkey % 7 AS f FROM orders)"""


def runs(spark, d):
    o = table(spark, d, "orders")
    a, b, c, f = F.col("o_custkey") % 3, F.col("o_orderkey") % 4, F.col("o_orderkey") % 5, F.col("o_custkey") % 7
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.when(c == 4, "odom").otherwise("map").alias("frame"), F.lit(True).alias("grid_ok"), (b != 3).alias("segmentation_ok"),
        (a != 0).alias("extrinsics_verified"), F.when(a == 2, "measured").otherwise("inferred").alias("extrinsics_source"), F.when(a == 1, "low").otherwise("high").alias("extrinsics_confidence"),
        F.lit(True).alias("dimensions_verified"), F.lit("measured").alias("dimensions_source"), F.lit("high").alias("dimensions_confidence"), F.lit(True).alias("free_space_verified"),
        F.when(b == 1, "trajectory").otherwise("combined").alias("free_mode"), F.when(f == 0, 0).otherwise(10).alias("free_cells"), F.lit("occupied").alias("unknown_policy"), (f != 1).alias("operational"), F.lit(True).alias("connected"),
        F.when(f == 2, 1).otherwise(0).alias("unclassified"), F.lit(0).alias("overlapping"), F.when(f == 0, 0).otherwise(10).alias("free"), F.when(c == 3, 0.9).otherwise(0.3).alias("linear_speed"), F.lit(1.0).alias("angular_speed"), F.lit(1.0).alias("spacing"),
    )


@query("v9_readiness", RUNS + """ SELECT run_id, concat_ws(',', CASE WHEN b = 3 THEN 'nav2_route_segmentation_parameters_invalid' END, CASE WHEN c = 4 THEN 'navigation_frame_is_not_map' END, CASE WHEN a = 0 THEN 'lidar_extrinsics_unverified' END, CASE WHEN a = 1 THEN 'lidar_extrinsics_production_evidence_invalid' END,
 CASE WHEN f = 0 THEN 'no_explicit_observed_free_cells' END, CASE WHEN f = 1 THEN 'no_valid_operational_route' END) AS production,
 concat_ws(',', CASE WHEN b = 3 THEN 'nav2_route_segmentation_parameters_invalid' END, CASE WHEN c = 4 THEN 'navigation_frame_is_not_map' END, CASE WHEN a = 1 THEN 'lidar_extrinsics_evidence_below_closed_course_threshold' END, CASE WHEN b = 1 THEN 'closed_course_ground_free_space_evidence_not_enabled' END,
 CASE WHEN f = 0 THEN 'no_explicit_observed_free_cells' END, CASE WHEN f = 1 THEN 'no_valid_closed_course_route' END) AS closed_course FROM r""")
def _(spark, d):
    r = qu.readiness(runs(spark, d))
    return r.select("run_id", F.array_join("production_blockers", ",").alias("production"), F.array_join("closed_course_blockers", ",").alias("closed_course"))


@query("v10_artifact_gate", RUNS + """ SELECT run_id, concat_ws(',', CASE WHEN f = 2 THEN 'occupancy_classification_partition_invalid' END, CASE WHEN f = 0 THEN 'no_explicit_free_cells' END, CASE WHEN b = 1 THEN 'trajectory_only_free_space_evidence_not_promotable' END, CASE WHEN c = 3 THEN 'closed_course_linear_speed_limit_invalid' END) AS blockers,
 NOT (f IN (0, 2) OR b = 1 OR c = 3) AS map_ready FROM r""")
def _(spark, d):
    return qu.artifact_gate(runs(spark, d)).select("run_id", F.array_join("map_blockers", ",").alias("blockers"), "map_ready")


@query("v11_check_lanelets", BASE + """ SELECT edge_id, 'speed_limit_invalid' AS code FROM edges WHERE edge_id % 9 = 2 UNION ALL SELECT edge_id, 'lanelet_area_zero' FROM edges WHERE edge_id % 6 = 3 AND edge_id % 10 <> 7 UNION ALL SELECT edge_id, 'missing_boundary' FROM edges WHERE edge_id % 10 = 7""")
def _(spark, d):
    s = lines(spark, d).select("run_id", "edge_id", "i", "x", "y", "z")
    off = F.when(F.col("edge_id") % 6 == 3, 0.0).otherwise(3.0)
    e = s.select("run_id", "edge_id").distinct().withColumn("speed", F.when(F.col("edge_id") % 9 == 2, 0.0).otherwise(1.0))
    return qu.check_lanelets(s.withColumn("y", F.col("y") + off), s.filter("edge_id % 10 <> 7"), e).select("edge_id", "code")


@query(
    "v12_swept_containment",
    ARC2 + HEX + """, bp AS (SELECT run_id, edge_id AS pose_i, i * 10000 + u.v * 100 + w.v AS k, x - 3e-1 + 18e-1 * u.v / 18 AS x, y - 4e-1 + 8e-1 * w.v / 8 AS y FROM samples_v, range(0, 19) u(v), range(0, 9) w(v)),
ins AS (SELECT DISTINCT pose_i, k FROM (SELECT p.pose_i, p.k, h.feature_id FROM bp p JOIN he h ON h.run_id = p.run_id AND (h.y > p.y) <> (h.qy > p.y) AND h.x + (p.y - h.y) * (h.qx - h.x) / (h.qy - h.y) >= p.x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1))
SELECT run_id, pose_i, count(*) AS outside_points FROM bp WHERE (pose_i, k) NOT IN (SELECT pose_i, k FROM ins) GROUP BY 1, 2""",
)
def _(spark, d):
    p = lines(spark, d).select("run_id", F.col("edge_id").alias("i"), F.col("i").alias("k"), "x", "y", F.lit(0.0).alias("yaw"))
    # the sample poses of an edge share its id, so they are told apart by their vertex
    rings = hexagons(spark, d).withColumnRenamed("feature_id", "ring_id")
    out = qu.swept_containment(p.withColumn("i", F.col("i") * 100 + F.col("k")), rings, 1.5, 0.3, 0.8)
    return out.groupBy("run_id", F.expr("pose_i div 100").alias("pose_i")).agg(F.count("*").alias("outside_points"))


@query("v14_acceptance", LINKS + f""", v AS (SELECT run_id, CASE WHEN passable THEN 'code_a' ELSE 'code_b' END AS code FROM links_v WHERE length > 10 * run_id), p AS (SELECT run_id, count(*) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM v GROUP BY 1)
SELECT r.run_id, {Q('1 - r.run_id * 2e-3')} AS coverage, coalesce(n, 0) AS violations, coalesce(codes, '') AS codes, coalesce(n, 0) = 0 AND 1 - r.run_id * 2e-3 >= 99e-2 AS accepted FROM (SELECT DISTINCT run_id FROM links_v) r LEFT JOIN p USING (run_id)""")
def _(spark, d):
    from drivegrid.functions.num import quantize

    e = links(spark, d)
    v = e.filter("length > 10 * run_id")  # longer than a run allows
    a = v.filter("passable").select("run_id", F.lit("code_a").alias("code"))
    b = v.filter("NOT passable").select("run_id", F.lit("code_b").alias("code"))
    cov = e.select("run_id").distinct().withColumn("coverage", 1 - F.col("run_id") * 2e-3)
    return qu.acceptance([a, b], cov).select("run_id", quantize(F.col("coverage")).alias("coverage"), "violations", F.array_join("codes", ",").alias("codes"), "accepted")


@query("v15_select_source", LINKS + """ SELECT edge_id AS run_id, CASE WHEN edge_id % 5 NOT IN (1, 2, 3) THEN 'edited' END AS source, CASE edge_id % 5 WHEN 1 THEN 'source_graph_missing' WHEN 2 THEN 'fingerprint_mismatch' WHEN 3 THEN 'frame_mismatch' END AS code FROM links_v""")
def _(spark, d):
    i = F.col("edge_id")
    e = links(spark, d)
    sel = e.select(i.alias("run_id"), F.lit("edited").alias("source"), i.cast("string").alias("fingerprint"), F.lit("map").alias("frame"))
    g = e.filter("edge_id % 5 <> 1").select(i.alias("run_id"), F.lit("edited").alias("source"), F.when(i % 5 == 2, "other").otherwise(i.cast("string")).alias("fingerprint"), F.when(i % 5 == 3, "odom").otherwise("map").alias("frame"))
    return qu.select_source(sel, g)


@query("v18_source_agreement", LINKS + """ SELECT run_id, CASE WHEN run_id % 2 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS sources, run_id % 2 <> 0 AS agree FROM (SELECT DISTINCT run_id FROM links_v)""")
def _(spark, d):
    e = links(spark, d)
    r = e.select("run_id").distinct().withColumn("source", F.lit("edited"))
    lanes = e.select("run_id", F.when((F.col("run_id") % 2 == 0) & (F.col("from_id") % 3 == 0), "recorded").otherwise("edited").alias("source"))
    return qu.source_agreement(r, r, lanes).select("run_id", "sources", "agree")
