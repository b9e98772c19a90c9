"""Queries over spans and rules on edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.lib.ordered import measured
from drivegrid.operators import intervals as iv
from drivegrid.operators import polylines as pl
from drivegrid.operators import trajectory as tr
from drivegrid.plans.polyline_queries import lines
from drivegrid.plans.registry import query
from drivegrid.plans.tables import view, with_views
from drivegrid.plans.trajectory_queries import q

BASE = with_views("samples_v", "spans_v") + """,
st3 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2), 0) AS d FROM samples_v WINDOW w AS (PARTITION BY run_id, edge_id ORDER BY i)),
arc3 AS (SELECT *, sum(d) OVER (PARTITION BY run_id, edge_id ORDER BY i) AS s FROM st3),
edges AS (SELECT run_id, edge_id, max(s) AS length, 1e0 AS speed, edge_id % 5 <> 0 AS passable FROM arc3 GROUP BY 1, 2),
sp AS (SELECT edge_id % 10 AS run_id, edge_id, feature_id, type, value, start_s, end_s FROM spans_v)"""


def arcs3(spark, d):
    return tr.arc_length(lines(spark, d), pl.EDGE)


def edges3(arc):
    return arc.groupBy(*pl.EDGE).agg(F.max("s").alias("length")).withColumns(
        {"speed": F.lit(1.0), "passable": F.col("edge_id") % 5 != 0}
    )


def spans(spark, d):
    return view(spark, d, "spans_v").withColumn("run_id", F.col("edge_id") % 10)


def sparse(df):
    """All features, 0.02 m long: leaves gaps on the edges."""
    return df.withColumn("end_s", F.col("start_s") + 0.02)


@query(
    "i1_merge_spans",
    BASE + f""", c AS (SELECT edge_id, start_s, start_s + 2e-2 AS end_s FROM sp),
m AS (SELECT *, max(end_s) OVER (PARTITION BY edge_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR start_s > r + 1e-8 THEN 1 ELSE 0 END) OVER (PARTITION BY edge_id ORDER BY start_s, end_s) AS k FROM m)
SELECT edge_id, {Q('min(start_s)')} AS start_s, {Q('max(end_s)')} AS end_s FROM g GROUP BY edge_id, k""",
)
def _(spark, d):
    return iv.merge_spans(sparse(spans(spark, d)), size=1.5).select("edge_id", q("start_s"), q("end_s"))


@query(
    "x2_elementary_breaks",
    BASE + f""", b AS (SELECT DISTINCT edge_id, s FROM (SELECT edge_id, start_s AS s FROM sp UNION ALL SELECT edge_id, end_s FROM sp))
SELECT edge_id, {Q('s')} AS s FROM (SELECT *, lag(s) OVER (PARTITION BY edge_id ORDER BY s) AS p FROM b) WHERE p IS NULL OR s - p >= 1e-8""",
)
def _(spark, d):
    s = spans(spark, d)
    b = s.select("run_id", "edge_id", F.explode(F.array("start_s", "end_s")).alias("s"))
    return iv.elementary_breaks(b).select("edge_id", q("s"))


RULES = BASE + """,
bk AS (SELECT DISTINCT run_id, edge_id, s FROM (SELECT run_id, edge_id, 0e0 AS s FROM edges UNION ALL SELECT run_id, edge_id, length FROM edges
  UNION ALL SELECT sp.run_id, sp.edge_id, least(greatest(start_s, 0), length) FROM sp JOIN edges USING (run_id, edge_id)
  UNION ALL SELECT sp.run_id, sp.edge_id, least(greatest(end_s, 0), length) FROM sp JOIN edges USING (run_id, edge_id))),
bl AS (SELECT run_id, edge_id, s FROM (SELECT *, lag(s) OVER (PARTITION BY run_id, edge_id ORDER BY s) AS p FROM bk) WHERE p IS NULL OR s - p >= 1e-8),
pc AS (SELECT run_id, edge_id, s AS start_s, lead(s) OVER (PARTITION BY run_id, edge_id ORDER BY s) AS end_s FROM bl),
rl AS (SELECT p.run_id, p.edge_id, p.start_s, p.end_s, coalesce(bool_or(sp.type = 'no_entry'), FALSE) AS no_entry, min(CASE WHEN sp.type = 'speed_limit' THEN sp.value END) AS v,
  count(DISTINCT sp.feature_id) AS features, coalesce(CAST(sum(sp.feature_id) AS BIGINT), 0) AS feature_sum
  FROM pc p LEFT JOIN sp ON sp.run_id = p.run_id AND sp.edge_id = p.edge_id AND (p.start_s + p.end_s) / 2 BETWEEN sp.start_s - 1e-8 AND sp.end_s + 1e-8 WHERE p.end_s > p.start_s + 1e-9 GROUP BY 1, 2, 3, 4)"""


def rules(spark, d):
    e = edges3(arcs3(spark, d))
    return e, iv.segment_rules(spans(spark, d), e)


@query(
    "i2_segment_rules",
    RULES + f""" SELECT rl.edge_id, {Q('start_s')} AS start_s, {Q('end_s')} AS end_s, no_entry, passable AND NOT no_entry AS effective_passable, {Q('coalesce(v, speed)')} AS effective_speed, features, feature_sum
FROM rl JOIN edges USING (run_id, edge_id)""",
)
def _(spark, d):
    _, r = rules(spark, d)
    total = F.aggregate("feature_ids", F.lit(0).cast("long"), lambda a, v: a + v)
    return r.select(
        "edge_id", q("start_s"), q("end_s"), "no_entry", "effective_passable", q("effective_speed"),
        F.size("feature_ids").cast("long").alias("features"), total.alias("feature_sum"),
    )


@query(
    "j20_rule_at_interval",
    BASE + """, p AS (SELECT run_id, edge_id, k.v * 5e-1 AS a, k.v * 5e-1 + 5e-1 AS b FROM edges, range(0, 20) k(v))
SELECT p.edge_id, a AS start_s, count(*) AS n, CAST(sum(feature_id) AS BIGINT) AS ids FROM p JOIN sp ON sp.edge_id = p.edge_id AND (a + b) / 2 BETWEEN start_s - 1e-8 AND end_s + 1e-8 GROUP BY 1, 2""",
)
def _(spark, d):
    e = edges3(arcs3(spark, d)).select("run_id", "edge_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    p = e.select("run_id", "edge_id", (F.col("k") * 0.5).alias("start_s"), (F.col("k") * 0.5 + 0.5).alias("end_s"))
    return iv.rule_at_interval(p, spans(spark, d)).groupBy("edge_id", "start_s").agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


@query(
    "a17_edge_rules",
    RULES + f""" SELECT e.edge_id, bool_or(no_entry) AS no_entry, any_value(passable) AND NOT bool_or(no_entry) AS effective_passable, {Q('min(coalesce(v, speed))')} AS effective_speed
FROM rl JOIN edges e USING (run_id, edge_id) GROUP BY e.edge_id""",
)
def _(spark, d):
    e, r = rules(spark, d)
    return iv.edge_rules(r, e).select("edge_id", "no_entry", "effective_passable", q("effective_speed"))


# reverse partners: even edges have a mirrored twin with id + 1,000,000
TWIN = 1_000_000


def graph(spark, d):
    base = lines(spark, d)
    back = base.filter("edge_id % 2 = 0").select("run_id", (F.col("edge_id") + TWIN).alias("edge_id"), (49 - F.col("i")).alias("i"), "x", "y", "z")
    pts = measured(base.unionByName(back), source=base)
    arc = tr.arc_length(pts, pl.EDGE)
    e = edges3(arc)
    base_id = F.col("edge_id") % TWIN
    twin = F.when(base_id % 2 == 0, F.when(F.col("edge_id") >= TWIN, base_id).otherwise(base_id + TWIN))
    first, last = base_id * 2 + 1, base_id * 2 + 2
    is_twin = F.col("edge_id") >= TWIN
    e = e.withColumns({"reverse_of": twin, "from_id": F.when(is_twin, last).otherwise(first), "to_id": F.when(is_twin, first).otherwise(last)})
    ends = arc.filter(~is_twin).filter("i = 0 OR i = 49")
    nodes = ends.select("run_id", (F.col("edge_id") * 2 + F.when(F.col("i") == 0, 1).otherwise(2)).alias("node_id"), "x", "y", "z")
    return nodes, e, arc


@query(
    "i5_reverse_span",
    BASE + f""" SELECT CAST(sp.edge_id + 1000000 AS BIGINT) AS edge_id, feature_id, {Q('least(greatest(length - end_s, 0), length)')} AS start_s, {Q('least(greatest(length - start_s, 0), length)')} AS end_s
FROM sp JOIN edges USING (run_id, edge_id) WHERE sp.edge_id % 2 = 0""",
)
def _(spark, d):
    _, e, _ = graph(spark, d)
    return iv.reverse_spans(spans(spark, d), e).select("edge_id", "feature_id", q("start_s"), q("end_s"))


# rules on every edge: feature spans, also authored on the twins with other bounds
I3 = BASE + """,
ge AS (SELECT run_id, edge_id, length FROM edges UNION ALL SELECT run_id, edge_id + 1000000, length FROM edges WHERE edge_id % 2 = 0),
gs AS (SELECT run_id, edge_id, start_s, end_s FROM sp UNION ALL SELECT run_id, edge_id + 1000000, start_s + 33e-2, end_s + 33e-2 FROM sp WHERE edge_id % 2 = 0),
tw AS (SELECT DISTINCT run_id, edge_id FROM gs),
raw AS (SELECT ge.run_id, ge.edge_id, unnest([0, length, least(greatest(start_s, 0), length), least(greatest(end_s, 0), length)]) AS s FROM ge JOIN gs USING (run_id, edge_id)
 UNION ALL SELECT ge.run_id, ge.edge_id, unnest([least(greatest(length - start_s, 0), length), least(greatest(length - end_s, 0), length)]) FROM ge JOIN tw USING (run_id, edge_id)
  JOIN gs ON gs.run_id = ge.run_id AND gs.edge_id = CASE WHEN ge.edge_id >= 1000000 THEN ge.edge_id - 1000000 ELSE ge.edge_id + 1000000 END),
b1 AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY edge_id ORDER BY s) AS p FROM (SELECT DISTINCT run_id, edge_id, s FROM raw)) WHERE p IS NULL OR s - p >= 1e-8),
gv AS (SELECT run_id, edge_id, i, s FROM arc3 WHERE i BETWEEN 1 AND 48 UNION ALL SELECT a.run_id, a.edge_id + 1000000, 49 - i, e.length - s FROM arc3 a JOIN edges e USING (run_id, edge_id) WHERE i BETWEEN 1 AND 48 AND a.edge_id % 2 = 0),
b2 AS (SELECT DISTINCT b1.run_id, b1.edge_id, coalesce((SELECT min_by(v.s, abs(v.s - b1.s)) FROM gv v WHERE v.edge_id = b1.edge_id AND abs(v.s - b1.s) <= 1e-3 + 1e-9), b1.s) AS s FROM b1)
"""


def some_rules(spark, d):
    s = spans(spark, d)
    other = s.filter("edge_id % 2 = 0").withColumns(
        {"edge_id": F.col("edge_id") + TWIN, "start_s": F.col("start_s") + 0.33, "end_s": F.col("end_s") + 0.33}
    )
    return s.unionByName(other)


@query("i3_sync_reverse_breaks", I3 + f" SELECT edge_id, {Q('s')} AS s FROM b2")
def _(spark, d):
    _, e, arc = graph(spark, d)
    return iv.sync_reverse_breaks(some_rules(spark, d), e, arc).select("edge_id", q("s"))


def split_graph(spark, d, keep=True):
    nodes, e, arc = graph(spark, d)
    r = iv.segment_rules(some_rules(spark, d), e)
    return nodes, e, arc, iv.apply_rules(e, nodes, arc, r, keep_no_entry=keep)


@query(
    "i4_apply_rules",
    I3 + f""", al AS (SELECT run_id, edge_id, s FROM b2 UNION SELECT run_id, edge_id, s FROM raw WHERE s < 0
  UNION SELECT run_id, edge_id, 0 FROM ge UNION SELECT run_id, edge_id, length FROM ge),
pp AS (SELECT run_id, edge_id, s AS s0, lead(s) OVER (PARTITION BY edge_id ORDER BY s) AS s1 FROM al)
SELECT edge_id AS source_edge_id, count(*) AS children, {Q('sum(s1 - s0)')} AS covered, {Q('max(s1)')} AS last_s FROM pp WHERE s1 > s0 + 1e-8 GROUP BY edge_id""",
)
def _(spark, d):
    *_, (_, _, _, lineage) = split_graph(spark, d)
    return lineage.groupBy("source_edge_id").agg(
        F.count("*").alias("children"), quantize(F.sum(F.col("s1") - F.col("s0"))).alias("covered"), quantize(F.max("s1")).alias("last_s")
    )


@query("i4_apply_rules_vertices", None)
def _(spark, d):
    *_, (nodes, edges, verts, lineage) = split_graph(spark, d, keep=False)
    n = verts.groupBy("run_id", "edge_id").agg(F.count("*").alias("vertices"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))
    return edges.join(n, ["run_id", "edge_id"]).select("run_id", "edge_id", "from_id", "to_id", q("length"), "vertices", "first_i", "last_i")


@query(
    "i6_interval_coverage",
    BASE + """, c AS (SELECT run_id, edge_id, edge_id * 4 + k.v AS child_id, length * k.v / 4 + CASE WHEN edge_id % 7 = 1 AND k.v = 2 THEN 1e-1 WHEN edge_id % 7 = 2 AND k.v = 1 THEN -1e-1 ELSE 0 END AS s0, length * (k.v + 1) / 4 - CASE WHEN edge_id % 7 = 3 AND k.v = 3 THEN 2e-1 ELSE 0 END AS s1 FROM edges, range(0, 4) k(v) WHERE edge_id % 7 <> 4)
SELECT edge_id, child_id, code FROM (SELECT edge_id, child_id, CASE WHEN edge_id % 7 = 1 AND child_id % 4 = 2 THEN 'gap' WHEN edge_id % 7 = 2 AND child_id % 4 = 1 THEN 'overlap' WHEN edge_id % 7 = 3 AND child_id % 4 = 3 THEN 'does_not_end_at_length' END AS code FROM c) WHERE code IS NOT NULL
UNION ALL SELECT edge_id, NULL, 'not_covered' FROM edges WHERE edge_id % 7 = 4""",
)
def _(spark, d):
    e = edges3(arcs3(spark, d))
    k = F.col("k")
    m = F.col("edge_id") % 7
    c = e.filter(m != 4).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    shift = F.when((m == 1) & (k == 2), 0.1).when((m == 2) & (k == 1), -0.1).otherwise(0.0)
    c = c.select("run_id", "edge_id", (F.col("edge_id") * 4 + k).alias("child_id"), (F.col("length") * k / 4 + shift).alias("s0"),
                 (F.col("length") * (k + 1) / 4 - F.when((m == 3) & (k == 3), 0.2).otherwise(0.0)).alias("s1"))
    return iv.interval_coverage(c, e).select("edge_id", "child_id", "code")


# a plain lineage: every edge cut into three equal children
LIN = BASE + """, lin AS (SELECT run_id, edge_id AS source_edge_id, 5000000 + edge_id * 3 + k.v AS edge_id, length * k.v / 3 AS s0, length * (k.v + 1) / 3 AS s1 FROM edges, range(0, 3) k(v) WHERE NOT (edge_id % 6 = 0 AND k.v = 1))"""


def lineage(spark, d):
    e = edges3(arcs3(spark, d)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter("NOT (edge_id % 6 = 0 AND k = 1)")
    L = F.col("length")
    return e.select("run_id", F.col("edge_id").alias("source_edge_id"), (5000000 + F.col("edge_id") * 3 + F.col("k")).alias("edge_id"), (L * F.col("k") / 3).alias("s0"), (L * (F.col("k") + 1) / 3).alias("s1"))


@query(
    "i7_remap_route",
    LIN + """, r AS (SELECT run_id, run_id AS route_id, row_number() OVER (PARTITION BY run_id ORDER BY edge_id DESC) AS pos, edge_id FROM edges)
SELECT r.route_id, row_number() OVER (PARTITION BY r.route_id ORDER BY r.pos, l.s0) - 1 AS pos, l.edge_id, r.edge_id AS source_edge_id FROM r LEFT JOIN lin l ON l.run_id = r.run_id AND l.source_edge_id = r.edge_id""",
)
def _(spark, d):
    from pyspark.sql.window import Window

    lin = lineage(spark, d)
    e = edges3(arcs3(spark, d))
    r = e.select("run_id", F.col("run_id").alias("route_id"), F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("edge_id"))).alias("pos"), "edge_id")
    return iv.remap_route_after_split(r, lin).select("route_id", "pos", "edge_id", "source_edge_id")


@query(
    "i7_remap_stops",
    LIN + f""", st AS (SELECT run_id, feature_id AS stop_id, edge_id, start_s AS s FROM sp),
h AS (SELECT st.stop_id, st.edge_id AS src, st.s, l.edge_id, s0, s1, row_number() OVER (PARTITION BY st.stop_id ORDER BY s0 DESC) AS rn FROM st LEFT JOIN lin l ON l.run_id = st.run_id AND l.source_edge_id = st.edge_id AND s BETWEEN s0 - 1e-8 AND s1 + 1e-8)
SELECT stop_id, edge_id, CASE WHEN edge_id IS NOT NULL THEN {Q('greatest(0, s - s0)')} END AS s, src AS source_edge_id FROM h WHERE rn = 1 OR edge_id IS NULL""",
)
def _(spark, d):
    st = spans(spark, d).select("run_id", F.col("feature_id").alias("stop_id"), "edge_id", F.col("start_s").alias("s"))
    out = iv.remap_stops_after_split(st, lineage(spark, d))
    return out.select("stop_id", "edge_id", F.when(F.col("edge_id").isNotNull(), quantize(F.col("s"))).alias("s"), "source_edge_id")


@query(
    "i8_spans_match_graph",
    BASE + """ SELECT feature_id, NOT (feature_id % 4 = 1 OR sp.end_s > length) AS matches FROM sp JOIN edges USING (run_id, edge_id)""",
)
def _(spark, d):
    arc = arcs3(spark, d)
    s = spans(spark, d).join(arc.groupBy("run_id", "edge_id").agg(F.max("s").alias("L")), ["run_id", "edge_id"])
    a = pl.sample_at_arc(arc, s.select("run_id", "edge_id", "feature_id", F.col("start_s").alias("t"))).select("feature_id", *[F.col(k).alias(f"a{k}") for k in "xyz"])
    b = pl.sample_at_arc(arc, s.select("run_id", "edge_id", "feature_id", F.col("end_s").alias("t"))).select("feature_id", *[F.col(k).alias(f"b{k}") for k in "xyz"])
    s = s.drop("L").join(a, "feature_id").join(b, "feature_id").withColumn("by", F.col("by") + F.when(F.col("feature_id") % 4 == 1, 0.01).otherwise(0.0))
    return iv.spans_match_graph(s, lines(spark, d)).select("feature_id", "matches")


@query(
    "i9_insert_stops",
    BASE + f""", seg AS (SELECT *, lead(x) OVER w AS x1, lead(s) OVER w AS s1 FROM arc3 WINDOW w AS (PARTITION BY edge_id ORDER BY i)),
dn AS (SELECT edge_id, x + (coalesce(x1, x) - x) * j / n AS x, s + (coalesce(s1, s) - s) * j / n AS s FROM (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, greatest(1, coalesce(CAST(ceil((s1 - s) / 2e-1) AS BIGINT), 1)) AS n FROM seg))),
stp AS (SELECT edge_id, feature_id, start_s AS s FROM sp),
al AS (SELECT edge_id, s, x, NULL AS stop_id FROM dn UNION ALL SELECT p.edge_id, p.s, g.x + (g.x1 - g.x) * (p.s - g.s) / (g.s1 - g.s), feature_id FROM stp p JOIN seg g ON g.edge_id = p.edge_id AND p.s > g.s AND p.s <= g.s1)
SELECT edge_id, count(*) AS points, count(stop_id) AS stops, {Q('sum(s)', 4)} AS sum_s, {Q('sum(x)', 4)} AS sum_x FROM al GROUP BY edge_id""",
)
def _(spark, d):
    st = spans(spark, d).select("run_id", "edge_id", F.col("feature_id").alias("stop_id"), F.col("start_s").alias("s"))
    out = iv.insert_stops(lines(spark, d), st, 0.2)
    return out.groupBy("edge_id").agg(F.count("*").alias("points"), F.count("stop_id").alias("stops"), quantize(F.sum("s"), 4).alias("sum_s"), quantize(F.sum("x"), 4).alias("sum_x"))


F29 = BASE + """, wide AS (SELECT run_id, CASE WHEN feature_id % 13 = 0 THEN edge_id + 900000 ELSE edge_id END AS edge_id, feature_id, start_s, end_s + CASE WHEN feature_id % 11 = 0 THEN 1000 ELSE 0 END AS end_s FROM sp),
cd AS (SELECT w.*, CASE WHEN e.length IS NULL THEN 'unknown_edge' WHEN w.end_s > e.length + 1e-8 THEN 'span_out_of_range' END AS code FROM wide w LEFT JOIN edges e USING (run_id, edge_id))"""


def wide(spark, d):
    f = F.col("feature_id")
    return spans(spark, d).withColumns({
        "edge_id": F.when(f % 13 == 0, F.col("edge_id") + 900000).otherwise(F.col("edge_id")),
        "end_s": F.col("end_s") + F.when(f % 11 == 0, 1000).otherwise(0),
    })


@query("f29_filter_semantics", F29 + f" SELECT edge_id, feature_id, {Q('end_s')} AS end_s FROM cd WHERE code IS NULL")
def _(spark, d):
    return iv.filter_semantics(wide(spark, d), edges3(arcs3(spark, d)))[0].select("edge_id", "feature_id", q("end_s"))


@query(
    "f29_semantics_diagnostics",
    F29 + """ SELECT edge_id, feature_id, code FROM cd WHERE code IS NOT NULL
UNION ALL SELECT NULL, feature_id, 'feature_excluded' FROM cd GROUP BY feature_id HAVING count(*) FILTER (code IS NULL) = 0""",
)
def _(spark, d):
    return iv.filter_semantics(wide(spark, d), edges3(arcs3(spark, d)))[1].select("edge_id", "feature_id", "code")


@query(
    "j26_anchor_whole_edges",
    BASE + f""", f AS (SELECT DISTINCT run_id, edge_id, feature_id FROM sp),
a AS (SELECT edge_id, max(s) AS end_s, min_by(x, i) AS ax, max_by(x, i) AS bx FROM arc3 GROUP BY 1) SELECT feature_id, edge_id, {Q('end_s')} AS end_s, {Q('ax')} AS ax, {Q('bx')} AS bx FROM f JOIN a USING (edge_id)""",
)
def _(spark, d):
    f = spans(spark, d).select("run_id", "feature_id", F.array("edge_id").alias("edge_ids"))
    return iv.anchor_whole_edges(f, lines(spark, d)).select("feature_id", "edge_id", q("end_s"), q("ax"), q("bx"))
