"""Reference geometries with known answers."""

import math

from pyspark.sql import functions as F

from drivegrid.lib.ordered import measured
from drivegrid.operators import cells as ce
from drivegrid.operators import graph as gr
from drivegrid.operators import intervals as iv
from drivegrid.operators import trajectory as tr
from drivegrid.streaming import jobs


def test_swept_body_is_continuous(spark):
    """Two poses four metres apart: the midpoint has been driven over."""
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)],
                              "run_id long, i long, x double, y double, z double, qx double, qy double, qz double, qw double")
    grid = ce.grid_extent(p, 2.0, 0.1)
    cells = {(r.cx, r.cy) for r in ce.sweep_footprint(measured(p), grid, 0.1, "rectangle", 0.5, 0.5, 1.0, 0.1).collect()}
    assert (40, 20) in cells and (40, 38) not in cells


def test_one_edge_rules(spark):
    """10 m edge; 0.4 on [2,5], 0.2 on [4,8], no entry on [6,7]: six pieces."""
    e = spark.createDataFrame([(1, 3, 10.0, 1.0, True)], "run_id long, edge_id long, length double, speed double, passable boolean")
    s = spark.createDataFrame([(1, 3, 1, "speed_limit", 0.4, 2.0, 5.0), (1, 3, 2, "speed_limit", 0.2, 4.0, 8.0), (1, 3, 3, "no_entry", 0.0, 6.0, 7.0)],
                              "run_id long, edge_id long, feature_id long, type string, value double, start_s double, end_s double")
    r = iv.segment_rules(s, e).orderBy("start_s").collect()
    assert [(x.start_s, x.effective_speed, x.effective_passable) for x in r] == [
        (0.0, 1.0, True), (2.0, 0.4, True), (4.0, 0.2, True), (5.0, 0.2, True), (6.0, 0.2, False), (7.0, 0.2, True), (8.0, 1.0, True)]


def test_chains_and_cycles(spark):
    e = spark.createDataFrame([(1, 10, 1, 2), (1, 11, 2, 3), (1, 12, 3, 4), (1, 20, 7, 8), (1, 21, 8, 9), (1, 22, 9, 7)], "run_id long, edge_id long, from_id long, to_id long").withColumn("passable", F.lit(True))
    got = {r.edge_id: (r.head_edge_id, r.pos, r.on_cycle) for r in gr.maximal_chains(e).collect()}
    assert got == {10: (10, 0, False), 11: (10, 1, False), 12: (10, 2, False), 20: (20, 0, True), 21: (20, 1, True), 22: (20, 2, True)}


def test_jitter_is_corrected(spark):
    pts = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.9, 0.4), (3, 2.0, 0.4)]
    p = spark.createDataFrame([(1, i, i * 10, x, y, 0.0, 0.0, 0.0, 0.0, 1.0) for i, x, y in pts],
                              "run_id long, i long, stamp_ns long, x double, y double, z double, qx double, qy double, qz double, qw double")
    out = {r.i: (round(r.x, 6), round(r.y, 6), r.corrected) for r in tr.fix_position_jitter(measured(p)).collect()}
    assert out[1] == (round(2 / 3, 6), round(0.4 / 3, 6), True) and out[0] == (0.0, 0.0, False)


def test_stream_register_matches_batch(spark, tmp_path):
    cols = "run_id long, stamp_ns long, x double, y double, z double, qx double, qy double, qz double, qw double"
    base = 1_700_000_000_000_000_000
    sec = 1_000_000_000
    poses = spark.createDataFrame([(1, base + k * sec, float(k), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(0, 40)], cols)
    scans = spark.createDataFrame([(1, k, base + k * sec + sec // 2) for k in range(0, 36, 5)] + [(1, 99, base + 39 * sec)], "run_id long, scan_id long, stamp_ns long")
    for name, df in (("poses", poses), ("scans", scans)):
        df.write.parquet(str(tmp_path / name))
    read = lambda n, df: jobs.with_event_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / n)))
    st = jobs.stream_register(read("scans", scans), read("poses", poses), "1 second", "2 seconds")
    got = {r.scan_id: round(r.x, 6) for r in jobs.run_available(st, str(tmp_path / "o"), str(tmp_path / "c")).collect()}
    assert got and all(math.isclose(x, k + 0.5) for k, x in got.items())
    assert {0, 5, 10, 15, 20, 25} <= set(got)
