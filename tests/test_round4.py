"""Regressions of the fourth round of findings."""

import math

from pyspark.sql import functions as F

from drivegrid.lib.ordered import measured
from drivegrid.operators import trajectory as tr


def test_samples_do_not_drift_along_a_long_run(spark):
    """20,000 equal steps: a plain running sum is off by some 1e-9 m at the end."""
    n, step = 20_000, 0.3
    d = math.dist((0.0, 0.0), (0.1, 0.1))
    p = spark.range(n + 1).select(
        F.lit(1).cast("long").alias("run_id"), F.col("id").alias("i"), (F.col("id") * 1000).alias("stamp_ns"), (F.col("id") * 0.1).alias("x"), F.lit(0.0).alias("y"),
        ((F.col("id") % 2) * 0.1).alias("z"), *[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")], F.lit(1.0).alias("qw"),
    )
    for line in (measured(p), p):
        off = tr.resample(line, step).filter(F.col("s") > (n - 2000) * d).filter(F.col("s") < n * d - step)
        # x is the arc's share of 0.1 m a step
        assert off.agg(F.max(F.abs(F.col("x") - F.col("s") * (0.1 / d)))).first()[0] < 2e-11


def test_stream_keeps_poses_of_one_stamp(spark, tmp_path):
    """Each pose after the first at a stamp opens an island; all of them share what they end with."""
    from drivegrid.streaming import jobs

    rows = [(1, 0, 0, 0.0), (1, 1, 10**9, 0.01), (1, 2, 2 * 10**9, 0.02), (1, 3, 2 * 10**9, 0.02), (1, 4, 3 * 10**9, 0.03)]
    p = spark.createDataFrame([(r, s, t, x, 0.0, 0.0) for r, s, t, x in rows], "run_id long, seq long, stamp_ns long, x double, y double, z double")
    p.coalesce(1).write.parquet(f"{tmp_path}/poses")
    stream = jobs.with_event_time(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/poses"))
    out = jobs.run_available(jobs.stream_segments(stream, 0.45, 0.02, 0.005, "40 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r.stamp_ns // 10**9, r.island, round(r.arc, 6), r.late) for r in out.collect()) == [
        (0, 0, 0.0, False), (1, 0, 0.01, False), (2, 1, 0.01, False), (2, 1, 0.01, False), (3, 1, 0.02, False)
    ]


def test_stream_registration_pairs_no_scan_with_all_poses(spark, tmp_path):
    """Ids beyond 2^53 stay; a scan without a pose on both sides within the gap is left out; nothing is joined."""
    from drivegrid.streaming import jobs

    minute, big = 60 * 10**9, 2**60 + 1
    cols = "run_id long, seq long, stamp_ns long, x double, y double, z double, qx double, qy double, qz double, qw double"
    # the last pose moves the watermark past the scans
    p = spark.createDataFrame([(1, k, t * minute, float(t), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k, t in enumerate([0, 10, 20, 100, 400])], cols)
    s = spark.createDataFrame([(1, big, 10 * minute), (1, 2, 15 * minute), (1, 3, 60 * minute), (1, 4, 399 * minute)], "run_id long, scan_id long, stamp_ns long")
    p.coalesce(1).write.parquet(f"{tmp_path}/p")
    s.coalesce(1).write.parquet(f"{tmp_path}/s")
    read = lambda df, name: jobs.with_event_time(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}"))
    out = jobs.stream_register(read(s, "s"), read(p, "p"), "30 minutes", "31 minutes")
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    got = jobs.run_available(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r.scan_id, r.x) for r in got.collect()) == [(2, 15.0), (big, 10.0)]


class FakeMap(dict):
    """Map state that counts its writes."""

    writes = 0

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def getValue(self, key):
        return self[key]

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        self.pop(key)


class FakeHandle:
    def __init__(self):
        self.maps, self.value = {}, None

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, FakeMap())

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_hub_of_the_streamed_graph_is_written_once_a_call(monkeypatch):
    """400 edges at one node, half of them deleted again; a small hold writes more often, the graph is the same."""
    import pandas as pd

    from drivegrid.streaming import jobs

    blank = dict.fromkeys(["node_id", "edge_id", "from_id", "to_id", "child1_id", "child2_id", "new_node_id", "reverse_id", "child1_reverse_id", "child2_reverse_id"])
    op = lambda n, kind, **more: {"op": n, "type": kind, **blank, "direction": "one_way", "cascade": True, "include_reverse": False, "x": 0.0, "y": 0.0, "z": 0.0} | more
    log = [op(k, "add_node", node_id=k) for k in (1, 2)]
    log += [op(10 + k, "add_edge", edge_id=k, from_id=1, to_id=2) for k in range(400)]
    log += [op(1000 + k, "delete_edge", edge_id=k) for k in range(0, 400, 2)]
    log += [op(2000, "move_node", node_id=2, x=5.0), op(2001, "add_edge", edge_id=1, from_id=1, to_id=2)]
    graphs = []
    for hold in (200_000, 3):
        monkeypatch.setattr(jobs, "HELD_ENTITIES", hold)
        handle, fold = FakeHandle(), jobs._graph_fold()
        fold.init(handle)
        said = pd.concat(list(fold.handleInputRows((7,), iter([pd.DataFrame(log[:300]), pd.DataFrame(log[300:])]), None)))
        assert said[said["code"].notna()][["op", "code"]].values.tolist() == [[2001, "duplicate_id"]]
        graphs.append((dict(handle.maps["nodes"]), dict(handle.maps["edges"]), handle.value))
        if hold > 400:
            assert handle.maps["nodes"].writes == 2 and handle.maps["edges"].writes == 200
    assert graphs[0] == graphs[1] and set(graphs[0][1]) == {(k,) for k in range(1, 400, 2)}
    assert graphs[0][0][(2,)][0] == 5.0 and len(graphs[0][0][(1,)][3].split(",")) == 200


def test_vertices_follow_drives_that_meet_their_own_poses(spark):
    """Guesses go wrong where a vertex inside a segment lies on another pose; the result is that of matching by place."""
    import random

    from drivegrid.operators import authoring as au

    rng, poses, vertices = random.Random(4), [], []
    for run in range(1, 7):
        # a walk on a grid of 2 m with midpoints that are poses of other passes
        at = [(0.0, 0.0)]
        while len(at) < 60:
            x, y = at[-1]
            dx, dy = rng.choice([(2, 0), (-2, 0), (0, 2), (0, -2), (1, 0), (0, 1)])
            at.append((x + dx, y + dy))
        poses += [(run, i, x, y, 0.0, 0.0, 0.0, 0.0, 1.0) for i, (x, y) in enumerate(at)]
        line = []
        for a, b in zip(at, at[1:]):
            line += [a] + ([((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)] if rng.random() < 0.4 else [])
        line.append(at[-1])
        if run == 3:
            line[70] = (50.0, 50.0)
        if run == 4:
            line[0] = (9.0, 9.0)
        vertices += [(run, k, x, y, 0.0) for k, (x, y) in enumerate(line)]
    p = spark.createDataFrame(poses, "run_id long, i long, x double, y double, z double, qx double, qy double, qz double, qw double")
    v = spark.createDataFrame(vertices, "run_id long, v long, x double, y double, z double")
    seg = au.O.with_neighbours(p.withColumn("yaw", F.lit(0.0)), ["run_id"], "i", ["x", "y", "z", "yaw"], back=0, ahead=1)
    want = sorted((r.run_id, r.v, r.i, r.ratio) for r in au._match_by_places(v, p, seg, 1e-6, 1.0).collect())
    for rounds in (1, 4, 40):
        got = [r for r in au.match_vertices_to_poses(v, p, rounds=rounds).collect()]
        assert sorted((r.run_id, r.v, r.pose_i, r.ratio) for r in got if r.matches) == want and len(got) == len(vertices)
    assert len([w for w in want if w[0] == 3]) == 70 and not [w for w in want if w[0] == 4]


def test_vertices_are_not_paired_with_the_poses_of_a_cell(spark):
    """A drive within one cell of a metre: no step sees more rows than a few times its vertices."""
    from drivegrid.operators import authoring as au

    n = 3000
    p = spark.range(n).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("i"), (F.col("id") * 2e-4).alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("z"),
                              *[F.lit(0.0).alias(k) for k in ("qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    v = p.select("run_id", F.col("i").alias("v"), "x", "y", "z")
    called = []
    places = au._match_by_places
    au._match_by_places = lambda *a: called.append(1) or places(*a)
    try:
        assert au.match_vertices_to_poses(v, p).filter("matches AND pose_i = v").count() == n
    finally:
        au._match_by_places = places
    assert not called


def random_rings(rng, n, first, sides, wide):
    """Star-shaped rings, many not convex, some with a corner on another ring's."""
    import math

    rows = []
    for r in range(first, first + n):
        cx, cy, k = rng.uniform(0, 6), rng.uniform(0, 6), rng.choice(sides)
        rows += [(1, r, i, cx + wide * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / k), cy + wide * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]
    return rows


def by_ring(rows):
    out = {}
    for _, r, _, x, y in rows:
        out.setdefault(r, []).append((x, y))
    return out


def holds(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and ax + (y - ay) * (bx - ax) / (by - ay) >= x:
            odd = not odd
    return odd


def touching(a, b):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if any(holds(b, *p) for p in a) or any(holds(a, *p) for p in b):
        return True
    sides = lambda r: list(zip(r, r[1:] + r[:1]))
    return any(turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0 for p, q in sides(a) for r, s in sides(b))


def between(ring, step):
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        n = max(1, math.ceil(math.dist((ax, ay), (bx, by)) / step))
        yield from ((ax + (bx - ax) * t / n, ay + (by - ay) * t / n) for t in range(n))


def test_rings_meet_in_their_cell_and_pairs_do_not_leave_it(spark, monkeypatch):
    """Points in rings, rings in rings and overlaps against brute force, also when a cell is spread over calls."""
    import random

    from drivegrid.lib import rings as R
    from drivegrid.operators import quality as qu
    from drivegrid.operators import spatial as sp

    rng = random.Random(9)
    ring = "run_id long, ring_id long, i long, x double, y double"
    big, small = random_rings(rng, 40, 100, (3, 4, 6, 9), 2.0), random_rings(rng, 60, 500, (3, 5, 6), 0.5)
    a, b = by_ring(small), by_ring(big)
    spots = [(1, k, rng.uniform(-1, 7), rng.uniform(-1, 7)) for k in range(300)]
    # corners are on the border
    spots += [(1, 1000 + k, x, y) for k, (_, _, _, x, y) in enumerate(big[:20])]
    f = lambda rows, name: spark.createDataFrame(rows, ring.replace("ring_id", name))
    p = spark.createDataFrame(spots, "run_id long, k long, x double, y double")
    poses = spark.createDataFrame([(1, k, x, y, 0.3 * k) for _, k, x, y in spots[:40]], "run_id long, i long, x double, y double, yaw double")
    for pairs in (4_000_000, 50):
        monkeypatch.setattr(R, "PAIRS_A_GROUP", pairs)
        monkeypatch.setattr(R, "PAIRS_A_BLOCK", pairs)
        inside = sp.points_in_polygons(p, f(big, "ring_id"), ["run_id", "k"], ["run_id", "ring_id"])
        got = {(r.k, r.ring_id) for r in inside.collect()}
        assert got >= {(k, r) for _, k, x, y in spots for r, c in b.items() if holds(c, x, y)}
        assert {g for g in got if g[0] < 1000} == {(k, r) for _, k, x, y in spots[:300] for r, c in b.items() if holds(c, x, y)}
        assert {(1000 + k, big[k][1]) for k in range(20)} <= got
        over = sp.polygon_overlaps(f(small, "a_id"), f(big, "b_id"), "a_id", "b_id")
        got = [(r.a_id, r.b_id) for r in over.collect()]
        assert len(got) == len(set(got)) and set(got) == {(m, n) for m, c in a.items() for n, d in b.items() if touching(c, d)}
        held = sp.polygon_contained(f(small, "a_id"), f(big, "b_id"), "a_id", "b_id", step=0.05)
        want = {(m, n) for m, c in a.items() for n, d in b.items() if all(holds(d, *s) for s in between(c, 0.05))}
        assert {(r.a_id, r.b_id) for r in held.collect()} == want and want
        out = qu.swept_containment(poses, f(big, "ring_id"), 1.0, 0.5, 0.8, step=0.25)
        want = 0
        for _, k, x, y in spots[:40]:
            for u in range(7):
                for v in range(5):
                    lx, ly, c, s = -0.5 + 1.5 * u / 6, -0.4 + 0.8 * v / 4, math.cos(0.3 * k), math.sin(0.3 * k)
                    want += not any(holds(d, x + c * lx - s * ly, y + s * lx + c * ly) for d in b.values())
        assert out.count() == want > 0
    for df in (inside, over, held, out):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.index("FlatMapCoGroups") < min([plan.index(w) for w in ("Aggregate", "Join") if w in plan])


def test_few_points_meet_long_segments_in_few_cells(spark, monkeypatch):
    """A small radius does not cut long segments into its cells: ten anchors, segments of 30 m."""
    from drivegrid.operators import spatial as sp

    seg = spark.range(400).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("i"), (F.col("id") * 0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
                                  F.lit(0.0).alias("s"), (F.col("id") * 0.1 + 0.3).alias("x1"), F.lit(30.0).alias("y1"), F.lit(0.0).alias("z1"), F.lit(30.0).alias("s1"))
    p = spark.range(10).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("anchor_id"), (F.col("id") * 4.0).alias("x"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(-5.0).alias("y"), F.lit(0.0).alias("z"))
    copies, cover = [], sp.cover_box
    monkeypatch.setattr(sp, "cover_box", lambda *a, **k: copies.append(cover(*a, **k)) or copies[-1])
    got = sorted((r.anchor_id, r.edge_id, round(r.distance, 9)) for r in sp.nearest_segments(p, seg, 1e-3).collect())
    assert got == [(k, 40 * k, 0.0) for k in range(0, 10, 2)]
    assert copies[0].count() <= 4 * 400
    # anchors of one place, and none at all
    assert sp.meeting_size(p.filter("anchor_id = 3"), 1e-3) >= 0.05 and sp.nearest_segments(p.filter("anchor_id > 99"), seg, 1e-3).count() == 0


def test_coverage_stops_at_the_first_near_segment(spark):
    from drivegrid.operators import spatial as sp

    line = measured(spark.createDataFrame([(1, i, 2.0 * i, 0.0, 0.0) for i in range(3)], "run_id long, i long, x double, y double, z double"))
    seg = spark.range(50).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("edge_id"), F.lit(0.0).alias("x"), (F.col("id") * 1e-3).alias("y"), F.lit(2.0).alias("x1"), (F.col("id") * 1e-3).alias("y1"))
    out = sp.coverage(line, seg, 0.4)
    # samples of 0.2 m: those up to x = 2.4 are near
    assert [(r.samples, r.covered) for r in out.collect()] == [(21, 13)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_samples_beyond_the_grid_are_one_row(spark):
    """A line of 1 km beside a grid of ten cells has a row for each cell in it and one for the rest."""
    from drivegrid.operators import spatial as sp

    line = measured(spark.createDataFrame([(1, 1, 0, 0.1, 0.1, 0.0), (1, 1, 1, 1000.0, 0.1, 0.0)], "run_id long, edge_id long, i long, x double, y double, z double"))
    grid = spark.createDataFrame([(1, 0.0, 0.0, 10, 10)], "run_id long, origin_x double, origin_y double, width long, height long")
    cells = spark.createDataFrame([(1, 2, 0, True, False), (1, 3, 0, False, False)], "run_id long, cx long, cy long, obstacle boolean, unknown boolean")
    per = sp.cell_counts(line, grid, 0.5)
    assert per.count() == 11
    total, off = per.groupBy().sum("n").first()[0], per.filter("NOT _in").first().n
    r = sp.route_vs_grid(line, cells, grid, 0.5).first()
    assert (r.obstacle_samples, r.off_map_samples) == (4, off) and r.unknown_samples == total - off - 8 and off > 7900
