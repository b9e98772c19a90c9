"""Stream jobs drained over the supplied events, next to their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drivegrid.functions.num import quantize, quantize_sql as Q
from drivegrid.plans.graph_queries import ops as edit_log, published
from drivegrid.plans.registry import CHECKS, query
from drivegrid.plans.tables import US, VIEWS, prepare, table, with_views
from drivegrid.session import ensure_checkpoint_dir
from drivegrid.streaming import jobs


def scratch(spark) -> str:
    """A fresh folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def source(spark, d, name):
    """File stream with the rows of a view."""
    prepare(spark)
    base, columns, _ = VIEWS[name]
    raw = spark.readStream.schema(table(spark, d, base).schema).option("pathGlobFilter", f"{base}.parquet").parquet(d)
    return raw.selectExpr(*[f"{e.format(us=US['spark'])} AS {n}" for n, e in columns.items()])


def drain(spark, stream):
    root = scratch(spark)
    return jobs.run_available(stream, f"{root}/out", f"{root}/cp")


@query("st3_stream_dedupe", with_views("poses_v") + " SELECT run_id, stamp_ns - stamp_ns % 7200000000000 AS stamp_ns FROM poses_v GROUP BY 1, 2")
def _(spark, d):
    p = source(spark, d, "poses_v").withColumn("stamp_ns", F.expr("stamp_ns - stamp_ns % 7200000000000"))
    return drain(spark, jobs.stream_dedupe(jobs.with_event_time(p), "40 days")).select("run_id", "stamp_ns")


@query("st3_stream_last_pose", with_views("poses_v") + """, c AS (SELECT run_id, stamp_ns - stamp_ns % 7200000000000 AS stamp_ns, seq, y FROM poses_v)
SELECT run_id, stamp_ns, max(seq) AS seq, arg_max(y, seq) AS y FROM c WHERE stamp_ns < (SELECT max(stamp_ns) FROM c) GROUP BY 1, 2""")
def _(spark, d):
    p = source(spark, d, "poses_v").withColumn("stamp_ns", F.expr("stamp_ns - stamp_ns % 7200000000000"))
    # the newest stamp stays open until the watermark passes it
    return drain(spark, jobs.stream_last_pose(jobs.with_event_time(p), delay="1 minute")).select("run_id", "stamp_ns", "seq", "y")


@query("st6_stream_quality", with_views("poses_v") + """, h AS (SELECT run_id, stamp_ns // 86400000000000 AS day, y FROM poses_v), m AS (SELECT max(day) AS last FROM h)
SELECT run_id, CAST(day AS BIGINT) AS day, count(*) AS decoded, count(*) FILTER (y < 12e-2) AS accepted FROM h, m WHERE day < last GROUP BY 1, 2""")
def _(spark, d):
    p = jobs.with_event_time(source(spark, d, "poses_v")).select("ts", "run_id", (F.col("y") < 0.12).alias("accepted"))
    # windows close when the watermark passes their end; the last day stays open
    out = drain(spark, jobs.stream_quality(p, "1 day", delay="1 minute"))
    return out.select("run_id", F.expr("unix_micros(start) div 86400000000L").alias("day"), "decoded", "accepted")


@query("st2_stream_voxels", with_views("points_v") + f""" SELECT run_id, CAST(floor(x / 1e0) AS BIGINT) AS vx, CAST(floor(y / 1e0) AS BIGINT) AS vy, CAST(floor(z / 1e0) AS BIGINT) AS vz, {Q('avg(x)', 5)} AS x, count(*) AS point_count, count(DISTINCT scan_id) AS observation_count FROM points_v GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    root = scratch(spark)
    p = source(spark, d, "points_v")
    run = p.writeStream.foreachBatch(jobs.append_voxels(1.0, f"{root}/parts")).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    v = jobs.read_voxels(spark.read.parquet(f"{root}/parts"))
    return v.select("run_id", "vx", "vy", "vz", quantize(F.col("x"), 5).alias("x"), "point_count", "observation_count")


@query("st4_stream_segments", with_views("poses_v") + f""", n AS (SELECT run_id, seq, stamp_ns, x, y, z, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(stamp_ns) OVER w AS pt FROM poses_v WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns)),
d AS (SELECT *, sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2) AS d, (stamp_ns - pt) * 1e-9 AS dt FROM n), b AS (SELECT *, CASE WHEN d > 45e-2 OR d / dt > 2e-2 THEN 1 ELSE 0 END AS k FROM d),
i AS (SELECT *, CAST(sum(k) OVER (PARTITION BY run_id ORDER BY stamp_ns) AS BIGINT) AS island FROM b)
SELECT run_id, stamp_ns, island, {Q('sum(CASE WHEN k = 1 THEN 0 ELSE coalesce(d, 0) END) OVER (PARTITION BY run_id, island ORDER BY stamp_ns)', 5)} AS arc FROM i""")
def _(spark, d):
    p = jobs.with_event_time(source(spark, d, "poses_v"))
    out = drain(spark, jobs.stream_segments(p, 0.45, 0.02, 0.05, "40 days"))
    return out.filter("NOT late").select("run_id", "stamp_ns", "island", quantize(F.col("arc"), 5).alias("arc"))


@query("st5_stream_edits", """SELECT o_orderkey % 10 AS graph_id, o_custkey AS entity_id, count(*) AS ops FROM orders GROUP BY 1, 2""")
def _(spark, d):
    raw = spark.readStream.schema(table(spark, d, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    ops = raw.select((F.col("o_orderkey") % 10).alias("graph_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("op"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("add").alias("type"))
    out = drain(spark, jobs.stream_edits(ops))
    return out.groupBy("graph_id", "entity_id").agg(F.count("*").alias("ops"))


@query("st5_stream_graph_edits", CHECKS["g11_replay_edits_edges"].replace(", FALSE AS manual", "").replace(", TRUE", ""))
def _(spark, d):
    """The log of the batch replay, folded by the stream: the same edges."""
    nodes, edges, log = edit_log(spark, d)
    null = F.lit(None).cast("long")
    base = jobs.graph_ops(nodes, edges.withColumn("reverse_of", null))
    log = log.withColumns({"child1_reverse_id": null, "child2_reverse_id": null, "cascade": F.lit(True)})
    rows = base.unionByName(log.select(*base.columns))
    root = scratch(spark)
    rows.write.parquet(f"{root}/log")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/log")
    changes = jobs.run_available(jobs.stream_graph_edits(stream), f"{root}/out", f"{root}/cp")
    return jobs.current_graph(changes)[1].select("run_id", *[published(c) for c in ("edge_id", "from_id", "to_id")])


@query("st1_stream_register", None)
def _(spark, d):
    """Events as poses; every event asks, a minute later, for its pose."""
    p = jobs.with_event_time(source(spark, d, "poses_v"))
    s = jobs.with_event_time(source(spark, d, "poses_v").select("run_id", F.col("seq").alias("scan_id"), (F.col("stamp_ns") + 60000000000).alias("stamp_ns")))
    out = drain(spark, jobs.stream_register(s, p, "30 minutes", "31 minutes"))
    return out.select("run_id", "scan_id", "stamp_ns", quantize(F.col("x")).alias("x"))
