"""File formats: binary points, images, tables."""

import struct

from pyspark.sql import functions as F

from drivegrid.operators import cells as ce
from drivegrid.sources import binary as bi
from drivegrid.sources import completed_map as cm
from drivegrid.sources import map_files as mf
from drivegrid.sources import point_ranges as pr
from drivegrid.sources import text_tables as tt
from drivegrid.sources import versions as vs

PTS = [(1.0, 2.0, 3.0, 0.5), (-1.5, 0.25, 8.0, 1.0)]


def test_point_files(spark, tmp_path):
    body = b"".join(struct.pack("<4f", *p) for p in PTS)
    (tmp_path / "a.pcd").write_bytes(
        b"# .PCD\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n" + body)
    (tmp_path / "b.ply").write_bytes(
        b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float intensity\nend_header\n" + body)
    (tmp_path / "c.ply").write_bytes(
        b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float intensity\nend_header\n1 2 3 0.5\nnan 0 0 1\n")
    got = bi.read_point_files(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path[-5], []).append((r.x, r.y, r.z, r.intensity))
    assert sorted(by["a"]) == sorted(PTS) and sorted(by["b"]) == sorted(PTS)
    assert by["c"] == [(1.0, 2.0, 3.0, 0.5)]


def test_map_image_round_trip(spark, tmp_path):
    (tmp_path / "m.pgm").write_bytes(b"P5\n# c\n2 2\n255\n" + bytes([0, 205, 254, 254]))
    px = bi.read_map_images(spark, str(tmp_path)).withColumn("run_id", F.lit(1))
    cells = {(r.cx, r.cy): (r.obstacle, r.observed_free, r.unknown) for r in ce.parse_trinary(px, False, 0.65, 0.196).collect()}
    # the first image row is the top
    assert cells[(0, 1)] == (True, False, False) and cells[(1, 1)] == (False, False, True) and cells[(0, 0)] == (False, True, False)


def test_strict_trajectory_and_publish(spark, tmp_path):
    lines = spark.createDataFrame([(1, "1.5 0 0 0 0 0 0 2"), (1, "# c"), (1, " "), (1, "x y"), (1, "2.5 0 0 inf 0 0 0 1")], "run_id long, value string")
    poses, rejects = tt.parse_tum(lines)
    assert [(r.stamp_ns, r.qw) for r in poses.collect()] == [(1_500_000_000, 1.0)]
    assert rejects.count() == 1
    vs.publish({"poses": poses}, str(tmp_path / "out"))
    assert vs.read_published(spark, str(tmp_path / "out"), "poses").count() == 1


def test_lane_map_xml(spark, tmp_path):
    from drivegrid.operators import authoring as au

    def write(name, shift):
        node = lambda i, x, y: f'<node id="{i}"><tag k="local_x" v="{x + shift}"/><tag k="local_y" v="{y}"/><tag k="ele" v="2.25"/></node>'
        way = lambda i, refs: f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "</way>"
        nodes = "".join(node(501 + k, 1.5 * k, 3.0 + 0.25 * k) + node(601 + k, 1.5 * k, -0.5) for k in range(3))
        (tmp_path / name).write_text(
            f"<osm>{nodes}" + way(71, [501, 502, 503]) + way(72, [601, 602, 603])
            + '<relation id="9"><member type="way" ref="71" role="left"/><member type="way" ref="72" role="right"/>'
            + '<tag k="type" v="lanelet"/><tag k="one_way" v="no"/></relation></osm>')

    write("a.osm", 0.0)
    write("b.osm", 100.0)
    n, w, r, t = au.read_lanelet_xml(spark, str(tmp_path / "*.osm"))
    lanes = {}
    for x in au.resolve_lanelets(n, w, r).collect():
        lanes.setdefault(x.run_id, []).append((x.role, x.i, x.x, x.y))
    want = [(role, k, 1.5 * k, y + slope * k) for role, y, slope in (("left", 3.0, 0.25), ("right", -0.5, 0.0)) for k in range(3)]
    assert sorted(sorted(v) for v in lanes.values()) == [want, [(a, k, x + 100.0, y) for a, k, x, y in want]]
    assert {(x.k, x.v) for x in t.collect()} == {("type", "lanelet"), ("one_way", "no")}


def test_pcd_counts_and_names(spark, tmp_path):
    import numpy as np

    kind = np.dtype([("n", "<f4", 3), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("obs", "<u4")])
    data = np.array([((9, 9, 9), 1, 1, 1, 4), ((8, 8, 8), 2, 3, 4, 5)], dtype=kind)
    head = "# .PCD\nVERSION 0.7\nFIELDS normal X Y Z observation_count\nSIZE 4 4 4 4 4\nTYPE F F F F U\nCOUNT 3 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA "
    (tmp_path / "b.pcd").write_bytes((head + "binary\n").encode() + data.tobytes())
    (tmp_path / "t.pcd").write_text(head + "ascii\n9 9 9 1 1 1 4\n8 8 8 2 3 4 5\n")
    got = {}
    for r in bi.read_point_files(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-5], []).append((r.x, r.y, r.z, r.observation_count))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(1.0, 1.0, 1.0, 4), (2.0, 3.0, 4.0, 5)] for k in "bt"}


def test_publishing_stops_between_tables(spark, tmp_path):
    """Whatever goes wrong before the last step, readers go on seeing the whole old set."""
    import pytest

    root = str(tmp_path / "store")
    rows = lambda k, runs: spark.createDataFrame([(r, k) for r in runs], "run_id long, x long")
    seen = lambda name: sorted(tuple(r) for r in vs.read_published(spark, root, name).select("run_id", "x").collect())
    with pytest.raises(FileNotFoundError):
        vs.read_published(spark, root, "a")
    assert vs.publish({"a": rows(1, [1, 2]), "b": rows(1, [1, 2])}, root) == 1
    broken = rows(2, [2]).withColumn("x", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        vs.publish({"a": rows(2, [2]), "b": broken}, root)
    assert vs.published_version(spark, root) == 1 and seen("a") == seen("b") == [(1, 1), (2, 1)]
    same_runs = lambda t: t["a"].select("run_id").exceptAll(t["b"].select("run_id"))
    with pytest.raises(ValueError, match="not published"):
        vs.publish({"a": rows(3, [7])}, root, same_runs)
    assert seen("a") == [(1, 1), (2, 1)]
    assert vs.publish({"a": rows(4, [2, 3]), "b": rows(4, [3])}, root, same_runs) == 4
    assert seen("a") == [(1, 1), (2, 4), (3, 4)] and seen("b") == [(1, 1), (2, 1), (3, 4)]
    assert sorted(tuple(r) for r in vs.read_published(spark, root, "a", 1).select("run_id", "x").collect()) == [(1, 1), (2, 1)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    import numpy as np

    kind = np.dtype([("pad", "u1"), ("x", "<f8"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4")])
    rng = np.random.default_rng(4)
    data = np.zeros(10_007, dtype=kind)
    for c in ("x", "y", "z", "intensity"):
        data[c] = rng.normal(size=len(data))
    data["z"][5] = np.nan
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 10007\nproperty uchar pad\nproperty double x\nproperty float y\nproperty float z\nproperty float intensity\nelement face 0\nend_header\n"
    (tmp_path / "big.ply").write_bytes(head + data.tobytes() + b"trailing")
    line = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "text.ply").write_bytes(line + b"1 2 3\n4 5 6\n7 8 9\n")
    (tmp_path / "none.ply").write_bytes(line.replace(b"vertex 3", b"vertex 0"))
    ranges = pr.read_point_ranges(spark, str(tmp_path), range_bytes=20_000)
    assert ranges.rdd.getNumPartitions() >= 11
    per = ranges.filter("path LIKE '%big%'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per) >= 11 and max(r["count"] for r in per) <= 20_000 // kind.itemsize + 1
    key = lambda df: sorted((r.path[-8:], r.x, r.y, r.z, r.intensity, r.observation_count) for r in df.collect())
    assert key(ranges) == key(bi.read_point_files(spark, str(tmp_path)))


def test_completed_map_in_one_call(spark):
    points = spark.createDataFrame([(1, k, 0.05 * k, 0.0, float(k % 4), 1.0) for k in range(40)], "run_id long, idx long, x double, y double, z double, intensity double")
    poses = spark.createDataFrame([(1, k * 10**9, float(k), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for k in range(3)], "run_id long, stamp_ns long, x double, y double, z double, qx double, qy double, qz double, qw double")
    got = cm.read_completed_map(points, poses, voxel=0.5, stride=2, min_z=-1.0, max_z=1.5, base_from_sensor=(0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    assert got.voxels.count() == got.report.first().map_voxels
    assert sorted((r.x, round(r.z, 9)) for r in got.poses.collect()) == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]
    r = got.report.first()
    assert (r.decoded_points, r.accepted_points, r.pose_messages) == (40, 10, 3)
    assert [w.split(":")[0] for w in r.warnings] == ["points_filtered", "points_voxelized", "range_limits_not_applied"]


def test_described_maps(spark, tmp_path):
    (tmp_path / "yaml").mkdir(), (tmp_path / "img").mkdir()
    image = lambda name, body: (tmp_path / "img" / name).write_bytes(body)
    image("a.pgm", b"P5\n3 2\n255\n" + bytes([0, 254, 205, 128, 0, 255]))
    image("b.pgm", b"P2\n2 1\n100\n0 90\n")
    image("short.pgm", b"P2\n2 2\n100\n0 90\n")
    image("high.pgm", b"P2\n2 1\n100\n0 101\n")
    write = lambda name, text: (tmp_path / "yaml" / name).write_text(text)
    write("a.yaml", "image: '../img/a.pgm'\nresolution: 0.5\norigin: [-1.5, 2, 0.0]\nnegate: 0\noccupied_thresh: 0.65\nfree_thresh: 0.196\n")
    write("b.yaml", f'image: "{tmp_path}/img/b.pgm"\nresolution: 1.0\nnegate: 1\nresolution: 0.25\n')
    write("c.yaml", "resolution: 0\norigin: [1, x, 0]\nfree_thresh: 0.9\n")
    for name in ("short", "high", "none"):
        write(f"{name}.yaml", f"image: {tmp_path}/img/{name}.pgm\nresolution: 1\n")
    got = mf.read_maps(spark, str(tmp_path / "yaml"), str(tmp_path / "img"))
    grids = {r.path[-6:-5]: (r.resolution, r.origin_x, r.origin_y, r.width, r.height) for r in got.grids.collect()}
    # the path of a leads through its own folder and is not normalised by the store
    assert grids["b"] == (0.25, 0.0, 0.0, 2, 1)
    cells = {(r.path[-6:-5], r.cx, r.cy): (r.obstacle, r.observed_free, r.unknown) for r in got.cells.collect()}
    assert cells["b", 0, 0] == (False, True, False) and cells["b", 1, 0] == (True, False, False)
    found = {(r.path.split("/")[-1], r.code) for r in got.violations.collect()}
    assert {("c.yaml", k) for k in ("image_missing", "resolution_not_positive", "origin_invalid", "thresholds_invalid")} <= found
    assert {("short.yaml", "image_truncated"), ("high.yaml", "pixel_out_of_range"), ("none.yaml", "image_not_found")} <= found
    assert grids["a"] == (0.5, -1.5, 2.0, 3, 2)
    assert cells["a", 0, 1] == (True, False, False) and cells["a", 1, 1] == (False, True, False) and cells["a", 2, 1] == (False, False, True) and cells["a", 2, 0] == (False, True, False)
