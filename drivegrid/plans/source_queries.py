"""Readers and writers over the supplied tables (write, parse back, compare)."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.lib.ordered import measured
from drivegrid.operators import polylines as pl
from drivegrid.operators import registration as reg
from drivegrid.operators import cells as ce
from drivegrid.plans.cell_queries import SUPPORT, classes, fixed_grid
from drivegrid.plans.graph_queries import LINKS, links
from drivegrid.plans.interval_queries import BASE, RULES, arcs3, edges3, rules, spans
from drivegrid.plans.polyline_queries import lines
from drivegrid.plans.registry import query
from drivegrid.plans.tables import table, view, with_views
from drivegrid.plans.trajectory_queries import q
from drivegrid.sources import binary as bi
from drivegrid.sources import geo_json as gj
from drivegrid.sources import text_tables as tt

P = with_views("poses_v")


@query("k2_write_tum", P + """ SELECT seq, concat_ws(' ', (stamp_ns // 1000000000)::VARCHAR || '.' || lpad((stamp_ns % 1000000000)::VARCHAR, 9, '0'), printf('%.3f', floor(x * 1e3) / 1e3)) AS value FROM poses_v""")
def _(spark, d):
    p = view(spark, d, "poses_v").withColumn("x", F.floor(F.col("x") * 1e3) / 1e3)
    out = tt.format_tum(p)
    f = F.split("value", " ")
    return out.select("seq", F.concat_ws(" ", f[0], F.regexp_replace(f[1], r"(\.\d{3})\d*$", "$1")).alias("value"))


@query("s1_read_tum", P + f""" SELECT seq, stamp_ns, {Q('x', 3)} AS x, {Q('qw / sqrt(qx*qx+qy*qy+qz*qz+qw*qw)', 3)} AS qw FROM poses_v WHERE seq % 7 <> 3""")
def _(spark, d):
    lines_ = tt.format_tum(view(spark, d, "poses_v"))
    broken = lines_.withColumn("value", F.when(F.col("seq") % 7 == 3, F.concat(F.lit("oops "), "value")).otherwise(F.col("value")))
    poses, _rejects = tt.parse_tum(broken)
    return poses.select("seq", "stamp_ns", q("x", 3), q("qw", 3))


@query("s1_read_tum_rejects", P + " SELECT run_id, count(*) AS rejects FROM poses_v WHERE seq % 7 = 3 GROUP BY run_id")
def _(spark, d):
    lines_ = tt.format_tum(view(spark, d, "poses_v"))
    broken = lines_.withColumn("value", F.when(F.col("seq") % 7 == 3, F.concat(F.lit("oops "), "value")).otherwise(F.col("value")))
    return tt.parse_tum(broken)[1].groupBy("run_id").agg(F.count("*").alias("rejects"))


def route_lines(spark, d):
    s = lines(spark, d)
    e = s.select("run_id", "edge_id").distinct().withColumns({"from_id": F.col("edge_id") * 2, "to_id": F.col("edge_id") * 2 + 1})
    n = s.filter("i IN (0, 49)").select("run_id", (F.col("edge_id") * 2 + F.when(F.col("i") == 0, 0).otherwise(1)).alias("node_id"), "x", "y", "z")
    return tt.format_route_table(n, e, s)


@query("s9_read_route_tables", with_views("samples_v") + f""" SELECT edge_id, i, {Q('x')} AS x, {Q('z')} AS z FROM samples_v""")
def _(spark, d):
    return tt.parse_route_table(route_lines(spark, d))[2].select("edge_id", "i", q("x"), q("z"))


@query("s9_route_table_violations", with_views("samples_v") + """ SELECT edge_id, CASE WHEN edge_id % 4 = 0 THEN 'sample_count_mismatch' END AS code FROM (SELECT DISTINCT edge_id FROM samples_v) WHERE edge_id % 4 = 0""")
def _(spark, d):
    f = F.split("value", "\t")
    gone = (f[0] == "SAMPLE") & (f[1].cast("long") % 4 == 0) & (f[2] == "7")
    return tt.parse_route_table(route_lines(spark, d).filter(~gone))[3].select("edge_id", "code")


@query("s10_read_semantics", with_views("spans_v") + f""" SELECT feature_id, edge_id, type, {Q('start_s')} AS start_s, 'a' || chr(9) || 'b\\' || feature_id AS name FROM spans_v""")
def _(spark, d):
    s = spans(spark, d)
    f, sp = tt.parse_semantics(tt.format_semantics(s.withColumn("name", F.concat(F.lit("a\tb\\"), F.col("feature_id").cast("string"))), s))
    return f.join(sp, ["run_id", "feature_id"]).select("feature_id", "edge_id", "type", q("start_s"), "name")


@query("s11_read_edit_log", with_views("samples_v") + f""" SELECT edge_id AS op, i, {Q('x', 4)} AS x FROM samples_v""")
def _(spark, d):
    s = lines(spark, d)
    ops = s.groupBy("run_id", F.col("edge_id").alias("op")).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("polyline"))
    log = tt.format_edit_log(ops.withColumns({"type": F.lit("add_edge"), "edge_id": F.col("op")}))
    back = tt.parse_edit_log(log).select("op", F.posexplode("polyline").alias("i", "p"))
    return back.select("op", F.col("i").cast("long").alias("i"), quantize(F.col("p.x"), 4).alias("x"))


def small_graph(spark, d):
    arc = arcs3(spark, d)
    e = edges3(arc).withColumns({"from_id": F.col("edge_id") * 2 + 1, "to_id": F.col("edge_id") * 2 + 2, "reverse_of": F.when(F.col("edge_id") % 2 == 0, F.col("edge_id") + 1).otherwise(F.col("edge_id") - 1)})
    n = arc.filter("i IN (0, 49)").select("run_id", (F.col("edge_id") * 2 + F.when(F.col("i") == 0, 1).otherwise(2)).alias("node_id"), "x", "y", "z")
    return n, e, arc


@query("s14_route_geojson_round_trip", BASE + f""" SELECT s.edge_id, i, {Q('x')} AS x, {Q('y')} AS y FROM samples_v s JOIN edges USING (run_id, edge_id) WHERE passable""")
def _(spark, d):
    n, e, s = small_graph(spark, d)
    return gj.parse_route_geojson(gj.to_route_geojson(n, e, s))[2].select("edge_id", "i", q("x"), q("y"))


@query("k3_route_geojson", BASE + f""", zz AS (SELECT edge_id, max(z) FILTER (i = 0) AS z_start, max(z) FILTER (i = 49) AS z_end FROM samples_v GROUP BY 1)
SELECT edge_id, CAST(edge_id * 2 + 1 AS BIGINT) AS from_id, CAST(edge_id * 2 + 2 AS BIGINT) AS to_id, {Q('length')} AS length, {Q('length / 9')} AS min_width, {Q('1 / length')} AS max_curvature, edge_id % 2 = 0 AS corridor_valid,
 CASE WHEN edge_id % 2 = 0 THEN edge_id + 1 ELSE edge_id - 1 END AS reverse_of, {Q('z_start')} AS z_start, {Q('z_end')} AS z_end FROM edges JOIN zz USING (edge_id) WHERE passable""")
def _(spark, d):
    n, e, s = small_graph(spark, d)
    e = e.withColumns({"min_width": F.col("length") / 9, "max_curvature": 1 / F.col("length"), "corridor_valid": F.col("edge_id") % 2 == 0})
    got = gj.parse_route_geojson(gj.to_route_geojson(n, e, s))[1]
    return got.select("edge_id", "from_id", "to_id", q("length"), q("min_width"), q("max_curvature"), "corridor_valid", "reverse_of", q("z_start"), q("z_end"))


@query("k4_corridor_geojson", BASE + """ SELECT edge_id, CAST(101 AS INTEGER) AS points, 101 AS coordinates FROM edges WHERE edge_id % 2 = 0""".replace("101 AS coordinates", "CAST(101 AS INTEGER) AS coordinates"))
def _(spark, d):
    n, e, s = small_graph(spark, d)
    c = s.withColumns({"left_x": F.col("x"), "left_y": F.col("y") + 1, "right_x": F.col("x"), "right_y": F.col("y") - 1})
    g = gj.to_corridor_geojson(e, c)
    ring = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<array<double>>>")
    return g.select("edge_id", "points", F.size(F.get(ring, F.lit(0))).alias("coordinates"))


@query(
    "k5_planner_graph",
    BASE + f""", sg AS (SELECT a.run_id, a.edge_id, a.i, lead(s) OVER (PARTITION BY a.edge_id ORDER BY i) - s AS l FROM arc3 a JOIN edges USING (run_id, edge_id) WHERE passable),
pc AS (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, greatest(1, CAST(ceil(l / 2e-1) AS BIGINT)) AS n FROM sg WHERE l IS NOT NULL))
SELECT run_id, count(*) AS edges, {Q('sum(l / n)', 4)} AS cost, {Q('max(l / n)')} AS longest FROM pc GROUP BY run_id""",
)
def _(spark, d):
    n, e, s = small_graph(spark, d)
    _, pe = gj.to_planner_graph(e, s, 0.2)
    return pe.groupBy("run_id").agg(F.count("*").alias("edges"), quantize(F.sum("cost"), 4).alias("cost"), quantize(F.max("cost")).alias("longest"))


@query(
    "k6_waypoints",
    BASE + """, sg AS (SELECT edge_id, greatest(1, CAST(ceil((lead(s) OVER (PARTITION BY edge_id ORDER BY i) - s) / 25e-2) AS BIGINT)) AS n FROM arc3)
SELECT edge_id, CAST(sum(coalesce(n, 1)) AS BIGINT) AS waypoints FROM sg GROUP BY edge_id""",
)
def _(spark, d):
    w = gj.to_waypoints(lines(spark, d), 0.25)
    return w.filter(F.col("yaw").isNotNull()).groupBy("edge_id").agg(F.count("*").alias("waypoints"))


@query(
    "k6_stop_waypoints",
    BASE + f""", v AS (SELECT edge_id, max(s) FILTER (i = 7) AS a, max(s) FILTER (i = 8) AS b FROM arc3 GROUP BY 1)
SELECT edge_id, edge_id + 1 AS stop_id, 'stop ' || edge_id AS stop_name, edge_id AS stop_edge_id, {Q('(a + b) / 2')} AS stop_edge_s, 3e0 AS stop_width FROM v""",
)
def _(spark, d):
    """A stop halfway between two vertices of every edge."""
    arc = arcs3(spark, d)
    at = arc.groupBy("run_id", "edge_id").agg(((F.max(F.when(F.col("i") == 7, F.col("s"))) + F.max(F.when(F.col("i") == 8, F.col("s")))) / 2).alias("s"))
    stops = at.withColumns({"stop_id": F.col("edge_id") + 1, "name": F.concat(F.lit("stop "), F.col("edge_id").cast("string")), "source_edge_id": F.col("edge_id"), "source_s": F.col("s"), "width": F.lit(3.0)})
    w = gj.to_stop_waypoints(lines(spark, d), stops, 0.25)
    return w.filter("stop_id IS NOT NULL AND yaw IS NOT NULL").select("edge_id", "stop_id", "stop_name", "stop_edge_id", q("stop_edge_s"), "stop_width")


@query(
    "k10_run_report",
    with_views("points_v", "poses_v") + f""", a AS (SELECT run_id, count(*) AS points, {Q('avg(z)')} AS mean_z FROM points_v GROUP BY 1), b AS (SELECT run_id, count(*) AS poses, max(stamp_ns) - min(stamp_ns) AS span_ns FROM poses_v GROUP BY 1)
SELECT run_id, points, mean_z, poses, span_ns FROM a JOIN b USING (run_id)""",
)
def _(spark, d):
    a = view(spark, d, "points_v").groupBy("run_id").agg(F.count("*").alias("points"), quantize(F.avg("z")).alias("mean_z"))
    b = view(spark, d, "poses_v").groupBy("run_id").agg(F.count("*").alias("poses"), (F.max("stamp_ns") - F.min("stamp_ns")).alias("span_ns"))
    return a.join(b, "run_id")


@query("s4_decode_clouds", with_views("points_v") + """ SELECT run_id, count(*) AS points FROM points_v GROUP BY run_id""")
def _(spark, d):
    """Points packed into little-endian payloads per scan and decoded again."""
    p = view(spark, d, "points_v").select("run_id", "scan_id", *[F.col(c).cast("float").alias(c) for c in ("x", "y", "z")])

    def pack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for (run, scan), g in pdf.groupby(["run_id", "scan_id"]):
                a = np.ascontiguousarray(g[["x", "y", "z"]].to_numpy("<f4"))
                rows.append((run, scan, len(a), 1, 12 * len(a), a.tobytes()))
            yield pd.DataFrame(rows, columns=["run_id", "scan_id", "width", "height", "row_step", "data"])

    msgs = p.mapInPandas(pack, "run_id long, scan_id long, width long, height long, row_step long, data binary")
    pts = bi.decode_clouds(msgs, {"x": (0, "f4"), "y": (4, "f4"), "z": (8, "f4")}, 12)
    return pts.groupBy("run_id").agg(F.count("*").alias("points"))


@query("s15_grid_thresholds", SUPPORT + """ SELECT run_id, count(*) FILTER (obstacle) AS obstacle, count(*) FILTER (observed_free) AS free FROM cls GROUP BY run_id""")
def _(spark, d):
    img = ce.to_trinary_cells(classes(spark, d), fixed_grid(view(spark, d, "points_v")))
    px = img.select("run_id", (F.lit(19) - F.col("cy")).alias("row"), F.col("cx").alias("col"), "pixel", F.lit(20).alias("height"))
    c = ce.parse_trinary(px, False, 0.65, 0.196)
    return c.groupBy("run_id").agg(F.count_if("obstacle").alias("obstacle"), F.count_if("observed_free").alias("free"))


@query("k12_edited_geojson", BASE + """ SELECT edge_id, CASE WHEN passable THEN 'VALID' ELSE 'INVALID' END AS status, CAST(50 AS INTEGER) AS points FROM edges""")
def _(spark, d):
    _, e, s = small_graph(spark, d)
    e = e.withColumns({"provenance": F.lit("generated"), "status": F.when(F.col("passable"), "VALID").otherwise("INVALID"), "errors": F.array().cast("array<string>")})
    g = gj.to_edited_geojson(e, s)
    pts = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<double>>")
    return g.select("edge_id", F.get_json_object("value", "$.properties.status").alias("status"), F.size(pts).alias("points"))


@query("k13_rules_json", RULES + f""" SELECT rl.edge_id, {Q('start_s', 5)} AS start_s, no_entry FROM rl""")
def _(spark, d):
    _, r = rules(spark, d)
    j = gj.to_rules_json(r)
    return j.select("edge_id", quantize(F.get_json_object("value", "$.start_s").cast("double"), 5).alias("start_s"), F.get_json_object("value", "$.no_entry").cast("boolean").alias("no_entry"))
