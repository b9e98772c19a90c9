"""Edit logs against a plain replay, and operators that once stopped at a fixed limit."""

import random

import pytest

from drivegrid.operators import cells, graph, registration
from drivegrid.streaming import jobs

OPS = (
    "run_id long, op long, type string, node_id long, edge_id long, from_id long, to_id long, child1_id long, child2_id long, new_node_id long, "
    "reverse_id long, child1_reverse_id long, child2_reverse_id long, direction string, cascade boolean, include_reverse boolean, x double, y double, z double"
)
FIELDS = [f.split()[0] for f in OPS.split(", ")]


def row(op, kind, **given):
    base = dict.fromkeys(FIELDS)
    return base | {"run_id": 1, "op": op, "type": kind, "direction": "one_way", "cascade": True, "include_reverse": False, "x": float(op), "y": 0.0, "z": 0.0} | given


def replay(nodes, edges, log):
    """One operation after the other on dictionaries."""
    n, e = dict(nodes), {k: [a, b, r] for k, (a, b, r) in edges.items()}

    def drop(k):
        e.pop(k, None)

    for o in log:
        kind, k = o["type"], o["edge_id"]
        partner = e[k][2] if k in e and e[k][2] in e and e[e[k][2]][2] == k else None
        if kind == "clear_graph":
            n.clear(), e.clear()
        elif kind in ("add_node", "move_node"):
            n[o["node_id"]] = o["x"]
        elif kind == "delete_node":
            n.pop(o["node_id"])
            for x in [x for x, v in e.items() if o["node_id"] in v[:2]]:
                drop(x)
        elif kind == "add_edge":
            both = o["direction"] == "both"
            e[k] = [o["from_id"], o["to_id"], o["reverse_id"] if both else None]
            if both:
                e[o["reverse_id"]] = [o["to_id"], o["from_id"], k]
        elif kind == "delete_edge":
            drop(k)
            if partner is not None and o["include_reverse"]:
                drop(partner)
        elif kind == "split_edge":
            a, b, _ = e[k]
            drop(k)
            n[o["new_node_id"]] = o["x"]
            r1, r2 = (o["child1_reverse_id"], o["child2_reverse_id"])
            e[o["child1_id"]], e[o["child2_id"]] = [a, o["new_node_id"], r1], [o["new_node_id"], b, r2]
            if partner is not None:
                drop(partner)
                e[r1], e[r2] = [o["new_node_id"], a, o["child1_id"]], [b, o["new_node_id"], o["child2_id"]]
        elif o["direction"] == "one_way":
            e[k][2] = None
            if partner is not None:
                drop(partner)
        else:
            e[k][2] = o["reverse_id"]
            e[o["reverse_id"]] = [e[k][1], e[k][0], k]
    return n, e


def random_log(seed, steps=60):
    rng = random.Random(seed)
    nodes = {k: 0.0 for k in range(1, 9)}
    edges = {100 + k: (rng.randint(1, 8), rng.randint(1, 8), None) for k in range(12)}
    edges = {k: (a, b if a != b else a % 8 + 1, None) for k, (a, b, _) in edges.items()}
    edges[111] = (*edges[110][:2][::-1], 110)
    edges[110] = (*edges[110][:2], 111)
    log, dead_n, dead_e, fresh = [], [], [], iter(range(1000, 9999))
    for op in range(1, steps + 1):
        n, e = replay(nodes, edges, log)
        kinds = ["add_node", "add_edge", "add_edge", "move_node", "move_node", "split_edge", "split_edge", "delete_edge", "delete_edge", "delete_node", "set_direction", "set_direction"]
        kind = rng.choice(kinds) if rng.random() > 0.01 else "clear_graph"
        pick = lambda s: rng.choice(sorted(s))
        again = lambda dead, alive: pick(set(dead) - set(alive)) if rng.random() < 0.5 and set(dead) - set(alive) else next(fresh)
        if kind == "clear_graph":
            o = row(op, kind)
        elif kind == "add_node":
            o = row(op, kind, node_id=again(dead_n, n))
        elif kind in ("move_node", "delete_node"):
            if not n:
                continue
            o = row(op, kind, node_id=pick(n))
        elif kind == "add_edge":
            if len(n) < 2:
                continue
            a, b = rng.sample(sorted(n), 2)
            both = rng.random() < 0.5
            o = row(op, kind, edge_id=again(dead_e, e), from_id=a, to_id=b, direction="both" if both else "one_way", reverse_id=next(fresh) if both else None)
        else:
            if not e:
                continue
            k = pick(e)
            partner = e[k][2] in e and e[e[k][2]][2] == k
            o = row(op, kind, edge_id=k)
            if kind == "split_edge":
                o |= {"child1_id": again(dead_e, e), "new_node_id": next(fresh), "child2_id": next(fresh)}
                if partner:
                    o |= {"child1_reverse_id": next(fresh), "child2_reverse_id": next(fresh)}
            elif kind == "delete_edge":
                o["include_reverse"] = rng.random() < 0.5
            elif not partner and rng.random() < 0.7:
                o |= {"direction": "both", "reverse_id": next(fresh)}
        log.append(o)
        n2, e2 = replay(nodes, edges, log)
        dead_n += [x for x in n if x not in n2]
        dead_e += [x for x in e if x not in e2]
    return nodes, edges, log


def frames(spark, nodes, edges, log):
    return (
        spark.createDataFrame([(1, k, x, 0.0, 0.0) for k, x in nodes.items()], "run_id long, node_id long, x double, y double, z double"),
        spark.createDataFrame([(1, k, a, b, r) for k, (a, b, r) in edges.items()], "run_id long, edge_id long, from_id long, to_id long, reverse_of long"),
        spark.createDataFrame([tuple(o[f] for f in FIELDS) for o in log], OPS),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_one_by_one(spark, seed):
    nodes, edges, log = random_log(seed)
    want_n, want_e = replay(nodes, edges, log)
    tables = frames(spark, nodes, edges, log)
    got_n, got_e = graph.replay_edits(*tables)
    assert {(r.node_id, r.x) for r in got_n.collect()} == set(want_n.items())
    assert sorted((r.edge_id, r.from_id, r.to_id) for r in got_e.collect()) == sorted((k, a, b) for k, (a, b, _) in want_e.items())
    assert graph.invalid_edits(*tables).collect() == []


def test_log_with_faults(spark):
    nodes, edges = {1: 0.0, 2: 0.0, 3: 0.0}, {10: (1, 2, None), 11: (2, 3, None)}
    log = [
        row(1, "move_node", node_id=50), row(2, "add_node", node_id=50), row(3, "add_node", node_id=50), row(4, "delete_edge", edge_id=10), row(5, "delete_edge", edge_id=10),
        row(6, "split_edge", edge_id=10, child1_id=20, child2_id=21, new_node_id=22), row(7, "delete_node", node_id=3, cascade=False), row(8, "add_edge", edge_id=11, from_id=1, to_id=2),
        row(9, "add_edge", edge_id=30, from_id=1, to_id=99), row(10, "delete_node", node_id=50), row(11, "add_node", node_id=50),
    ]
    found = {(r.op, r.code) for r in graph.invalid_edits(*frames(spark, nodes, edges, log)).collect()}
    assert found == {(1, "missing_entity"), (3, "duplicate_id"), (5, "missing_entity"), (6, "missing_entity"), (7, "incident_edges"), (8, "duplicate_id"), (9, "missing_entity")}


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(1, k, k, k + 1, 1.0) for k in range(70)], "run_id long, edge_id long, from_id long, to_id long, length double")
    ask = spark.createDataFrame([(1, 5, 0, 70, 80.0)], "run_id long, query_id long, from_node long, to_node long, max_length double")
    assert [(r.paths, r.shortest, r.hops) for r in graph.bounded_paths(edges, ask).collect()] == [(1, 70.0, 70)]


def test_frames_of_any_depth(spark):
    static = spark.createDataFrame([(f"f{k}", f"f{k + 1}", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(36)], "parent string, child string, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    target = spark.createDataFrame([("f0",)], "target string")
    got = {r.source: r.tx for r in registration.resolve_frames(static, target).collect()}
    assert len(got) == 37 and got["f36"] == pytest.approx(36.0)


def test_absolute_nanosecond_stamps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 1.7e18), (0, float("nan")), (0, 1e300)], "cloud long, raw double")
    got = [r[0] for r in df.select(registration.deskew_stamp(F.col("cloud"), F.col("raw"), 1e-9, 0.0, False)).collect()]
    assert got == [1_700_000_000_000_000_000, None, None]


def test_audit_lists_runs_without_cells(spark):
    grid = spark.createDataFrame([(1, 2, 3), (2, 4, 5)], "run_id long, width long, height long")
    some = spark.createDataFrame([(1, True, False, False)], "run_id long, obstacle boolean, observed_free boolean, unknown boolean")
    got = {r.run_id: (r.cells, r.obstacle, r.unknown) for r in cells.cell_partition_audit(some, grid).collect()}
    assert got == {1: (6, 1, 5), 2: (20, 0, 20)}


def test_scan_in_two_batches_counts_once(spark):
    point = lambda x: spark.createDataFrame([(1, 7, x, 0.5, 0.5, 2.0)], "run_id long, scan_id long, x double, y double, z double, intensity double")
    parts = jobs.voxel_sums(point(0.2), 1.0).unionByName(jobs.voxel_sums(point(0.4), 1.0)).unionByName(jobs.voxel_sums(point(float("nan")), 1.0))
    r = jobs.read_voxels(parts).collect()
    assert [(x.point_count, x.observation_count, round(x.x, 9), x.intensity) for x in r] == [(2, 1, 0.3, 2.0)]


def test_issues_name_the_fault_once_a_pair(spark):
    rows_ = [(1, 1, 2, True, 0.1, ["kept for later"]), (1, 2, 1, True, 0.1, []), (1, 3, None, False, 0.9, []), (1, 4, None, False, 0.9, ["too_narrow"]), (1, 5, None, True, 0.9, [])]
    e = spark.createDataFrame(rows_, "run_id long, edge_id long, reverse_of long, passable boolean, confidence double, errors array<string>")
    lines = spark.createDataFrame([(1, k, i, float(2 * i), 0.0, 0.0) for k in range(1, 6) for i in range(2)], "run_id long, edge_id long, i long, x double, y double, z double")
    got = {r.edge_id: (r.reason, r.x) for r in graph.edge_issues(e, 0.5, lines).collect()}
    assert got == {1: ("low confidence", 1.0), 3: ("clearance failed", 1.0), 4: ("too_narrow", 1.0)}


def test_streamed_log_equals_batch_replay(spark, tmp_path):
    """The same log in three micro-batches: the folded graph is the replayed one."""
    from pyspark.sql import functions as F

    nodes, edges, log = random_log(5, 45)
    want_n, want_e = replay(nodes, edges, log)
    n, e, ops = frames(spark, nodes, edges, log)
    base = jobs.graph_ops(n, e).select(*FIELDS)
    for k, part in enumerate((base, ops.filter("op <= 20"), ops.filter("op > 20").unionByName(ops.filter(F.col("op") == log[0]["op"])))):
        part.coalesce(1).withColumn("late", F.lit(k)).write.parquet(str(tmp_path / "log" / f"part={k}"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "log" / "*"))
    changes = jobs.run_available(jobs.stream_graph_edits(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got_n, got_e = jobs.current_graph(changes)
    assert {(r.node_id, r.x) for r in got_n.collect()} == set(want_n.items())
    assert sorted((r.edge_id, r.from_id, r.to_id) for r in got_e.collect()) == sorted((k, a, b) for k, (a, b, _) in want_e.items())
    assert [(r.op, r.code) for r in changes.filter("code IS NOT NULL").collect()] == [(log[0]["op"], "stale_operation")]


def test_stream_keeps_the_last_pose_of_a_stamp(spark, tmp_path):
    from pyspark.sql import functions as F

    rows_ = [(r, (1 + k // 3) * 10**9, k, float(k)) for r in (1, 2) for k in range(30)]
    spark.createDataFrame(rows_, "run_id long, stamp_ns long, seq long, x double").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, stamp_ns long, seq long, x double").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.stream_last_pose(jobs.with_event_time(stream), delay="1 millisecond"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.run_id, r.stamp_ns, r.seq, r.x) for r in out.collect())
    # the newest stamp waits for the watermark
    assert got == [(r, (1 + k) * 10**9, 3 * k + 2, float(3 * k + 2)) for r in (1, 2) for k in range(9)]


def test_stream_edits_share_state_and_calls(spark, tmp_path):
    """One state a bucket of entities, not one an entity; two files are two batches. Before, each of
    the 3,000 entities had a state and a call of its own."""
    rng = random.Random(5)
    log = [(g, rng.choice([None, *range(1500)]) if op % 9 == 0 else rng.randrange(1500), op, rng.choice(["add", "delete"])) for g in (1, 2) for op in range(1, 6001)]
    late = [(1, 7, 2, "add"), (1, 7, 9000, "add"), (1, 7, 9001, "add"), (1, 7, 9002, "delete")]
    ddl = "graph_id long, entity_id long, op long, type string"
    for k, rows in enumerate((log, late)):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    ops = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = jobs.stream_edits(ops, buckets=64).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]] == [12000, 4]
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 65
    want, state = set(), {}
    for rows in (log, late):
        for g, e, op, kind in sorted(rows, key=lambda r: r[2]):
            last, alive = state.get((g, e), (-1, False))
            ok = op > last and (kind == "add") != alive
            if ok:
                last, alive = op, kind == "add"
            state[g, e] = last, alive
            want.add((g, e, op, alive, ok))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("graph_id", "entity_id", "op", "alive", "accepted").collect()]
    assert len(got) == len(want) and set(got) == want
