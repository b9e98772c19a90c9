"""Joins and ids on tables larger than the usual test data."""

from pyspark.sql import functions as F

from drivegrid.lib.ordered import measured
from drivegrid.operators import polylines as pl

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_made_by_explode_are_not_broadcast_by_estimate(spark):
    """The plan's estimate is the file's size: a join may be broadcast only once it is measured."""
    from drivegrid.plans import catalog

    for name in ("j15_polygon_spans", "j18_coverage", "j17_polygon_contained"):
        assert "Broadcast" not in planned(catalog.QUERIES[name](spark, SF))


def test_short_lines_cross_without_cells(spark):
    """A long segment lies in very many cells; a line of four rows needs none of them."""
    from drivegrid.operators import spatial as sp

    rows = [(1, 1, i, x, y, 0.0) for i, (x, y) in enumerate([(0.0, 0.0), (40.0, 40.0), (40.0, 0.0), (0.0, 40.0)])]
    line = measured(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"))
    out = sp.self_intersections(line)
    assert [(r.edge_id, r.crossings, r.first_i) for r in out.collect()] == [(1, 1, 0)]
    assert "_bx" not in planned(out) and "_bx" in planned(sp.self_intersections(line.withColumn("i", F.col("i") + 0)))


def test_next_edges_are_folded_before_the_join(spark):
    """Routes that end at a busy node meet one row of it."""
    from drivegrid.operators import graph as gr

    e = spark.range(300).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("edge_id"), (F.col("id") % 2).alias("from_id"), (1 - F.col("id") % 2).alias("to_id"),
                                (F.col("id") != 3).alias("passable"), F.lit(None).cast("long").alias("reverse_of"), *[F.lit(0.0).alias(c) for c in ("sx", "sy", "sz", "ex", "ey", "ez", "sh", "eh")])
    out = gr.terminal_successor(e.select("run_id", F.col("edge_id").alias("route_id"), F.lit(0).alias("pos"), "edge_id"), e)
    got = {(r.route_id % 2, r.code) for r in out.collect()}
    assert got == {(0, "terminal_successor_no_entry_or_impassable"), (1, "terminal_successor_branch_ambiguous")}
    folded = planned(out)
    assert "min_by" in folded and "first(terminal_edge_id" not in folded


def test_dense_points_are_multiplied_before_they_are_divided(spark):
    """3 * (1/3) style shares are rounded twice: the SQL's points are x + (x1 - x) * k / n."""
    rows = [(1, 1, 0, 0.1, 0.0, 0.0), (1, 1, 1, 5.0, 0.0, 0.0)]
    line = measured(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"))
    got = [r.x for r in pl.densify(line, 0.1).orderBy("i").collect()]
    n = len(got) - 1
    want = [0.1 + (5.0 - 0.1) * k / n for k in range(n)] + [5.0]
    assert got == want and want != [0.1 + (5.0 - 0.1) * (k / n) for k in range(n)] + [5.0]


def test_made_ids_do_not_meet_stored_ones(spark, tmp_path):
    """Beyond three million links a made edge id is also the id of a stored edge."""
    from compare import difference, duck

    from drivegrid.plans import catalog

    near = [3000000 + k for k in range(0, 400, 10)]  # stored edges of run 0 in the range of made ones
    low = list(range(0, 400, 10))
    rows = [(k, 3 * k + 1, "O", 100.0) for k in low + near]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for name in ("g11_replay_edits_edges", "g11_invalid_edits"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).toArrow()
        assert difference(got, con.sql(catalog.CHECKS[name]).to_arrow_table()) is None, name


def test_long_segments_have_few_arc_buckets(spark):
    """A segment has copies in proportion to the line's mean segment, not to its metres."""
    far = 1.0e10
    line = measured(spark.createDataFrame([(1, 1, i, i * far, 0.0, 0.0, i * far) for i in range(3)], "run_id long, edge_id long, i long, x double, y double, z double, s double"))
    want = spark.createDataFrame([(1, 1, 0.25 * far), (1, 1, 1.5 * far), (1, 1, 9.0 * far)], "run_id long, edge_id long, t double")
    assert sorted(r.x for r in pl.sample_at_arc(line, want).collect()) == [0.25 * far, 1.5 * far, 2.0 * far]
    spans = spark.createDataFrame([(1, 1, 7, 0.5 * far, 1.5 * far)], "run_id long, edge_id long, slice_id long, s0 double, s1 double")
    assert [r.x for r in pl.slice_lines(line, spans).orderBy("i").collect()] == [0.5 * far, far, 1.5 * far]
    assert {(r.tx, r.ty) for r in pl.stable_tangent(line.drop("s"), 1.0).collect()} == {(1.0, 0.0)}


def test_dense_points_do_not_meet_in_a_shuffle(spark):
    """Pieces and bearings are made within a segment: the same rows as from neighbours."""
    from drivegrid.operators import spatial as sp
    from drivegrid.sources import geo_json as gj

    rows = [(1, e, i, x, y, 0.1 * i) for e in (1, 2) for i, (x, y) in enumerate([(0.0, 0.0), (3.0, 0.1), (3.0, 0.1), (2.0, 5.0 + e)][: 3 * e - 2 or 4])]
    line = measured(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"))
    dense = measured(pl.densify(line, 0.3, planar=False))
    for closed in (False, True):
        want = pl.waypoint_yaw(dense, closed).select("edge_id", "i", "x", "y", "z", "yaw").collect()
        got = gj.to_waypoints(line, 0.3, closed)
        assert sorted(got.select("edge_id", "i", "x", "y", "z", "yaw").collect()) == sorted(want)
        assert "_chunk" not in planned(got)
    flat = measured(pl.densify(line, 0.3))
    want = pl.segments(flat).select("edge_id", "x", "y", "x_n1", "y_n1").collect()
    assert sorted(map(tuple, pl.dense_segments(line, 0.3).select("edge_id", "x", "y", "x1", "y1").collect())) == sorted(map(tuple, want))
    cells = spark.createDataFrame([(1, 0, 0, False, False)], "run_id long, cx long, cy long, obstacle boolean, unknown boolean")
    grid = spark.createDataFrame([(1, 0.0, 0.0, 4, 1)], "run_id long, origin_x double, origin_y double, width long, height long")
    out = sp.trace_lines(line, cells, grid, 1.0)
    assert {(r.outside, r.occupied, r.unknown) for r in out.collect()} == {(True, False, True)}
    assert "_chunk" not in planned(out)


def test_cells_around_poses_are_reduced_in_their_batch(spark):
    """Every batch hands on one row per cell, ties go to the earliest pose."""
    from drivegrid.operators import cells as ce

    rows = [(1, i, 0.1 * (i // 2), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(40)]
    poses = spark.createDataFrame(rows, "run_id long, i long, x double, y double, z double, qx double, qy double, qz double, qw double")
    grid = spark.createDataFrame([(1, -2.0, -2.0, 16, 8)], "run_id long, origin_x double, origin_y double, width long, height long")
    out = ce.nearest_pose_per_cell(poses, grid, 1.0, 0.5)
    assert "Generate" not in planned(out)
    want = {}
    for _, i, x, y, *_ in rows:
        for cx in range(16):
            for cy in range(8):
                d2 = (-2.0 + (cx + 0.5) * 0.5 - x) ** 2 + (-2.0 + (cy + 0.5) * 0.5 - y) ** 2
                if d2 <= 1.0:
                    want[cx, cy] = min(want.get((cx, cy), (9.0, 0)), (d2, i))
    assert {(r.cx, r.cy): (r.d2, r.pose_i) for r in out.collect()} == want


def test_unions_do_not_fix_the_number_of_partitions(spark):
    """With 8 shuffle partitions ``i4_apply_rules`` failed at sf0.01: a union of 16 met a side of 8."""
    from drivegrid.plans import tables

    tables.view(spark, SF, "links_v")
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def curvature(spark, points, half_span=1.0):
    rows = [(1, 1, i, x, y, 0.0) for i, (x, y) in enumerate(points)]
    line = measured(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"))
    return pl.max_curvature(line, half_span)


def test_curvature_is_not_sampled_along_straight_segments(spark):
    """A corner of two long segments: some forty positions, not one every 0.1 m of 2 km."""
    import math

    out = curvature(spark, [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0)])
    assert abs(out.first().max_curvature - math.sqrt(2.0)) < 1e-9
    made = pl._curve_positions(
        spark.createDataFrame([(0.0, 1000.0, 2000.0, 1.0, 19980)], "s double, s_n1 double, _total double, _h double, _last long"), 0.1
    )
    assert 10 <= made.count() <= 20
    assert curvature(spark, [(0.0, 0.0), (500.0, 0.0), (1000.0, 0.0)]).first().max_curvature == 0.0


def test_curvature_of_short_and_long_segments_equals_brute_force(spark):
    """Segments of 0.05 to 9 m, so that points lie on the own, a near or a far segment."""
    import math

    pts, x = [], 0.0
    for k in range(120):
        x += (0.05, 0.3, 2.5, 9.0)[k // 5 % 4]
        pts.append((x, math.sin(k * 1.7) * (0.04 if k // 5 % 4 == 0 else 0.5)))
    s = [0.0]
    for a, b in zip(pts, pts[1:]):
        s.append(s[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))

    def at(t):
        t = min(max(t, 0.0), s[-1])
        j = next((j for j in range(len(s) - 1) if s[j] < t <= s[j + 1]), 0)
        r = (t - s[j]) / (s[j + 1] - s[j])
        return tuple(p + (q - p) * r for p, q in zip(pts[j], pts[j + 1]))

    def bend(t):
        a, b, c = at(t - 1.0), at(t), at(t + 1.0)
        area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        return 2 * area / (math.dist(a, b) * math.dist(b, c) * math.dist(a, c))

    want = max(bend(t) for t in [v for v in s if 1.0 <= v <= s[-1] - 1.0] + [min(1.0 + k * 0.1, s[-1] - 1.0) for k in range(int((s[-1] - 2.0 + 1e-9) / 0.1) + 1)])
    assert abs(curvature(spark, pts).first().max_curvature - want) < 1e-9


def test_stop_waypoints_are_made_within_their_segment(spark):
    """Stops between, on, at the ends of and beyond vertices; the points made never meet a shuffle."""
    from drivegrid.lib import ordered as O
    from drivegrid.operators import intervals as iv

    rows = [(1, e, i, x, y, 0.0) for e in (1, 2) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (1.0, 2.0), (3.0, 2.0)])]
    line = measured(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"))
    stops = spark.createDataFrame([(1, 1, k, s) for k, s in enumerate([0.0, 0.37, 1.0, 1.0 + 5e-10, 2.5, 3.0, 4.9, 5.0, 5.5])], "run_id long, edge_id long, stop_id long, s double")
    for closed in (False, True):
        got = iv.stop_waypoints(line, stops, 0.3, closed)
        want = pl.waypoint_yaw(O.measured(iv.insert_stops(line, stops, 0.3)), closed)
        cols = ["edge_id", "i", "s", "x", "y", "stop_id", "yaw"]
        assert sorted(map(tuple, got.select(cols).collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.select(cols).collect()), key=lambda r: r[:2])
        tree = planned(got)
        assert tree.index("posexplode") < tree.index("Exchange")
    one = iv.insert_stops(line, stops, 0.3).filter("edge_id = 1").orderBy("i").collect()
    assert [r.i for r in one] == list(range(len(one))) and [r.s for r in one] == sorted(r.s for r in one)
    assert [r.stop_id for r in one if r.stop_id is not None] == list(range(9))
    # no vertex is left within a nanometre of a stop
    plain, at = [r.s for r in one if r.stop_id is None], [r.s for r in one if r.stop_id is not None]
    assert min(abs(a - b) for a in plain for b in at) > 1e-9


def test_feature_ids_of_rules_are_not_shuffled(spark):
    """Ids are collected where pieces meet their spans: no exchange lies above that join."""
    from drivegrid.operators import intervals as iv

    spans = spark.createDataFrame([(1, 1, 7, "speed_limit", 0.4, 2.0, 5.0), (1, 1, 8, "no_entry", 0.0, 4.0, 6.0), (1, 1, 9, "speed_limit", 0.2, 4.0, 9.5)],
                                  "run_id long, edge_id long, feature_id long, type string, value double, start_s double, end_s double")
    edges = spark.createDataFrame([(1, 1, 10.0, 1.0, True), (1, 2, 3.0, 0.7, False)], "run_id long, edge_id long, length double, speed double, passable boolean")
    out = iv.segment_rules(spans, edges)
    tree = planned(out).split("Initial Plan")[-1]
    assert tree.index("Join") < tree.index("Exchange")
    got = {(r.edge_id, r.start_s, r.end_s): (r.no_entry, r.effective_passable, r.effective_speed, r.feature_ids) for r in out.collect()}
    assert got == {
        (1, 0.0, 2.0): (False, True, 1.0, []), (1, 2.0, 4.0): (False, True, 0.4, [7]), (1, 4.0, 5.0): (True, False, 0.2, [7, 8, 9]),
        (1, 5.0, 6.0): (True, False, 0.2, [8, 9]), (1, 6.0, 9.5): (False, True, 0.2, [9]), (1, 9.5, 10.0): (False, True, 1.0, []),
        (2, 0.0, 3.0): (False, False, 0.7, []),
    }


def test_points_that_meet_segments_are_not_shuffled(spark):
    """Many edges are near a point; its nearest one is found where they meet."""
    from drivegrid.operators import spatial as sp
    from drivegrid.plans.tables import prepare

    prepare(spark)
    seg = spark.range(40).select(
        F.lit(1).cast("long").alias("run_id"), F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("i"), F.lit(-5.0).alias("x"), (F.floor(F.col("id") / 2) * 0.01).alias("y"),
        (F.col("id") * 1.0).alias("z"), F.lit(0.0).alias("s"), F.lit(5.0).alias("x1"), (F.floor(F.col("id") / 2) * 0.01).alias("y1"), (F.col("id") * 1.0).alias("z1"), F.lit(10.0).alias("s1"))
    clicks = spark.createDataFrame([(1, 1, 0.2, 0.051), (1, 2, 0.2, 9.0), (1, 3, 0.2, 50.0)], "run_id long, anchor_id long, x double, y double")
    points = spark.createDataFrame([(1, 0.2, 9.0 + k / 10, 7.0 + k) for k in range(3)], "run_id long, x double, y double, z double")
    pairs = sp.near_pairs(clicks.withColumn("z", F.lit(0.0)), seg, 0.5, planar=True).groupBy(*sp.MEETING).agg(F.min("distance"))
    tree = planned(pairs).split("Initial Plan")[-1]
    assert tree.index("Join") < tree.index("Exchange") and "SortAggregate" not in tree
    got = {r.anchor_id: (r.z, r.source) for r in sp.auto_elevation(clicks, seg, points).collect()}
    assert got == {1: (10.0, "route"), 2: (7.0, "points"), 3: (None, "unavailable")}
    flat = seg.withColumns({"z": F.lit(0.0), "z1": F.lit(0.0)})
    near = sp.project_to_graph(clicks.withColumn("z", F.lit(0.0)), flat, 0.3, exhaustive=True).collect()
    assert {(r.anchor_id, r.edge_id, round(r.distance, 9), r.ambiguous) for r in near} == {(1, 10, 0.001, True), (2, 38, 8.81, True), (3, 38, 49.81, True)}


def test_few_cells_come_to_rays_and_bodies(spark):
    """Cells of a measured size are broadcast: what is made per vertex is not shuffled to them."""
    from drivegrid.plans import catalog

    for name in ("j13_lateral_clearance", "j14_footprint_overlap"):
        tree = planned(catalog.QUERIES[name](spark, SF)).split("Initial Plan")[-1]
        assert "BroadcastHashJoin [run_id" in tree and "SortMergeJoin [run_id" not in tree
        assert "SortAggregate" not in tree


def test_lines_of_a_file_do_not_meet_their_version_by_run(spark):
    """One file may hold most of the lines: its version comes to them."""
    from drivegrid.plans.tables import prepare
    from drivegrid.sources import records as rc

    prepare(spark)
    lines = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(["VERSION\t2", "FRAME\tmap", "NODE\tbroken"])], "run_id long, line long, value string")
    got = rc.parse_graph(lines)
    tree = planned(got.samples)
    assert "BroadcastHashJoin [run_id" in tree and "SortMergeJoin" not in tree
    assert [r.code for r in got.violations.collect()] == ["malformed_record"]


def test_stationary_filter_computes_its_poses_once(spark):
    """Every round reads the poses again; before, each read came from the source anew."""
    from drivegrid.operators import trajectory as tr

    n, read = 600, spark.sparkContext.accumulator(0)

    def pose(i):
        read.add(1)
        return 1, i, 0.1 * i, 0.0, 0.0

    poses = spark.createDataFrame(spark.sparkContext.range(n, numSlices=3).map(pose), "run_id long, i long, x double, y double, z double")
    got = tr.remove_stationary(poses, 0.95, chunk_rows=64).orderBy("i").collect()
    assert [round(r.x * 10) for r in got] == [*range(0, n, 10), n - 1] and [r.i for r in got] == list(range(len(got)))
    assert read.value == n


def test_long_segments_sweep_by_their_extreme_poses(spark, monkeypatch):
    """Open and closed lines of long and short segments against all poses and outline points. Before,
    every pose of a line was looked up on its own, three rows each."""
    import numpy as np
    from drivegrid.operators import corridor as co

    lines = {
        1: [(0, 0), (40, 3), (81, -2), (83, 30), (83.2, 30.1), (40, 31)],
        2: [(0, 0), (30, 0), (30, 20), (-5, 22), (0, 0)],
        3: [(0.3 * k, 0.05 * (k % 3)) for k in range(30)],
    }
    rows = [(1, e, i, float(x), float(y), 0.0) for e, line in lines.items() for i, (x, y) in enumerate(line)]
    asked, sample = [], pl.sample_at_arc
    monkeypatch.setattr(pl, "sample_at_arc", lambda line, targets, *a, **k: asked.append(targets.groupBy("edge_id").count().collect()) or sample(line, targets, *a, **k))
    got = co.swept_corridor(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"), 0.8, 0.9, 0.3).collect()
    got = {(r.edge_id, r.i): (r.left_offset, r.right_offset) for r in got}
    assert len(got) == len(rows)
    a, b = np.array(co.outline(0.8, 0.9, 0.3)).T
    for e, line in lines.items():
        p = np.array(line, dtype=float)
        d = np.hypot(*np.diff(p, axis=0).T)
        s, closed, last = np.r_[0, np.cumsum(d)], e == 2, len(p) - 1
        total, cap = s[-1], max(0.1, 0.5 * d.max() + 0.1)
        t = total * np.arange(np.ceil(total / 0.1) + 1) / np.ceil(total / 0.1)
        at = lambda w: np.array([np.interp(w % total if closed else w, s, p[:, k]) for k in (0, 1)])
        u = at(t + 0.25) - at(t - 0.25)
        (px, py), (ux, uy) = at(t), u / np.hypot(*u)
        x, y = px[:, None] + ux[:, None] * a - uy[:, None] * b, py[:, None] + uy[:, None] * a + ux[:, None] * b
        wide = np.full((last + 1, 2), 0.4)
        for i in range(last + 1):
            one, two = (p[1], p[-2]) if closed and i in (0, last) else (p[min(i + 1, last)], p[max(i - 1, 0)])
            tx, ty = (one - two) / np.hypot(*(one - two))
            along, left = (x - p[i, 0]) * tx + (y - p[i, 1]) * ty, (y - p[i, 1]) * tx - (x - p[i, 0]) * ty
            ok = np.abs(along) <= cap
            if not closed:
                ok |= ((i == 0) & (along <= 0) & (along >= -0.35)) | ((i == last) & (along >= 0) & (along <= 0.95))
            seen = np.zeros(len(t), dtype=bool)
            for turn in (-1, 0, 1) if closed else (0,):
                gap = s[i] + turn * total - t
                seen |= (gap >= -0.3 - cap) & (gap <= 0.9 + cap) & ((np.abs(gap) <= 0.5 * total) | (not closed))
            ok &= seen[:, None]
            wide[i] = max(0.4, left[ok].max()), max(0.4, -left[ok].min())
        for i in range(last + 1):
            want = wide[max(i - 1, 0) : i + 2].max(0) + 0.05
            assert np.allclose(got[e, i], want, atol=1e-6), (e, i, got[e, i], want)
    count = {r.edge_id: r["count"] for r in asked[0]}
    assert count.get(1, 0) < 100 and count.get(2, 0) < 100
