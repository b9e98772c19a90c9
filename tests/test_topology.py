"""Places and route graphs: small drives with known answers, and properties on random ones."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivegrid.operators import topology as tp


def walk(*corners, step=0.2):
    """Poses every ``step`` metres along a polyline of (x, y, z)."""
    out = [corners[0]]
    for a, b in zip(corners, corners[1:]):
        n = max(1, round(math.dist(a, b) / step))
        out += [tuple(p + (q - p) * k / n for p, q in zip(a, b)) for k in range(1, n + 1)]
    return out


def drive(spark, *runs):
    rows = [(r, k, float(x), float(y), float(z)) for r, run in enumerate(runs) for k, (x, y, z) in enumerate(run)]
    return tp.topology_samples(spark.createDataFrame(rows, "run_id long, i long, x double, y double, z double"))


def build(spark, *runs, near=0.45, crossing=0.30, separation=1.0, **more):
    s = drive(spark, *runs)
    nodes, edges, points = tp.build_topology(s, tp.cluster_revisits(s, near, crossing, separation), **more)
    return [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()], [r.asDict() for r in points.orderBy("run_id", "edge_id", "i").collect()]


def components(nodes, edges):
    parent = {n["node_id"]: n["node_id"] for n in nodes}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for e in edges:
        parent[root(e["from_id"])] = root(e["to_id"])
    return len({root(k) for k in parent})


CROSS = walk((-3, 0, 0), (3, 0, 0), (3, 3, 0), (0, 3, 0), (0, -3, 0))


def junctions(nodes, x, y, within):
    return [n for n in nodes if n["node_type"] == "junction" and math.hypot(n["x"] - x, n["y"] - y) < within]


LIFTED = [(x, y, 4.0 if k > 40 else z) for k, (x, y, z) in enumerate(CROSS)]
RING = [(5 * math.cos(k * math.pi / 80), 5 * math.sin(k * math.pi / 80), 0) for k in range(160)]
BACK = walk((0, 0, 0), (3, 0, 0), (2, 0, 0), (2, 3, 0))
STRAIGHT = walk((0, 0, 0), (50, 0, 0), step=0.5)
# a slanted crossing whose samples form two places, passed between in both orders
SLANTED = walk((-3, 0.9, 0), (3, -0.9, 0), step=0.17)
SLANTED += walk(SLANTED[-1], (5, -2, 0), (5, -5, 0), (0.5, -5, 0), (0.5, -3, 0), step=0.19)[1:] + walk((0.5, -3, 0), (-0.7, 3, 0), step=0.19)[1:]
RUNS = {"cross": CROSS, "lifted": LIFTED, "lap": RING + RING[:1], "laps": RING + RING + RING[:1], "back": BACK, "straight": STRAIGHT, "slanted": SLANTED, "one pose": [(0, 0, 0)]}


@pytest.fixture(scope="module")
def built(spark):
    """All drives in one table: the operators work on every run of it."""
    tables = build(spark, *RUNS.values(), reverse=True)
    return {name: tuple([r for r in t if r["run_id"] == k] for t in tables) for k, name in enumerate(RUNS)}


def forward(edges):
    return [e for e in edges if e["edge_id"] < e["reverse_of"]]


def test_crossing_is_one_junction(built):
    for name in ("cross", "slanted"):
        nodes, edges, _ = built[name]
        assert sum(n["node_type"] == "junction" and math.hypot(n["x"], n["y"]) < 0.6 for n in nodes) >= 1 and components(nodes, edges) == 1
        assert all(e["from_id"] != e["to_id"] for e in edges)
    assert len(junctions(built["cross"][0], 0, 0, 0.3)) == 1


def test_crossing_on_two_levels_is_no_junction(built):
    nodes, _, points = built["lifted"]
    assert not junctions(nodes, 0, 0, 0.6)
    assert {round(p["z"]) for p in points if math.hypot(p["x"], p["y"]) < 0.4} == {0, 4}


def test_second_lap_adds_no_edge(built):
    for name in ("lap", "laps"):
        nodes, edges, _ = built[name]
        edges = forward(edges)
        assert len(edges) >= 2 and components(nodes, edges) == 1 and all(e["from_id"] != e["to_id"] for e in edges)
        assert abs(sum(e["length"] for e in edges) - 10 * math.pi) < 0.5 and max(e["length"] for e in edges) <= 20.0 + 1e-9
    assert len(built["lap"][1]) == len(built["laps"][1])


def test_reversal_is_no_junction(built):
    cusp = [n for n in built["back"][0] if math.hypot(n["x"] - 3, n["y"]) < 1e-9]
    assert len(cusp) == 1 and cusp[0]["node_type"] != "junction"


def test_nodes_and_edges_are_numbered_in_order(built):
    nodes, edges, points = built["straight"]
    assert sorted(n["node_id"] for n in nodes) == [1, 2, 3, 4]
    e = sorted((x["edge_id"], x["from_id"], x["to_id"], x["reverse_of"]) for x in edges)
    assert [x[0] for x in e] == [5, 6, 7, 8, 9, 10] and [x[3] for x in e] == [8, 9, 10, 5, 6, 7]
    assert all(e[k][1:3] == e[k + 3][2:0:-1] for k in range(3))
    assert sorted(n["node_type"] for n in nodes) == ["endpoint", "endpoint", "normal", "normal"]
    lengths = {x["edge_id"]: x["length"] for x in edges}
    assert all(abs(lengths[k] - lengths[k + 3]) < 1e-9 for k in (5, 6, 7)) and abs(sum(lengths.values()) - 100) < 1e-6
    line = {k: [(p["x"], p["y"]) for p in points if p["edge_id"] == k] for k in (5, 8)}
    assert line[5] == line[8][::-1]


def test_a_single_pose_has_no_graph(built):
    assert built["one pose"] == ([], [], [])


def test_lanes_side_by_side_stay_apart(spark):
    lanes = walk((0, 0, 0), (5, 0, 0), (7, 2, 0), (5, 0.25, 0), (0, 0.25, 0))
    line = [(0, 0, 0), (4.9505, 0, 0), (9.9, 0, 0)]
    _, edges, points = build(spark, lanes, line, near=0.10, crossing=0.05, separation=2.0, min_length=0.1, max_length=5.0, window=0.0)
    ys = [p["y"] for p in points if p["run_id"] == 0 and 1 < p["x"] < 4 and p["y"] < 1]
    assert any(abs(y) < 0.05 for y in ys) and any(abs(y - 0.25) < 0.05 for y in ys)
    # a cut half a millimetre before a vertex moves onto it
    mine = [e["length"] for e in edges if e["run_id"] == 1]
    assert len(mine) == 2 and abs(sum(mine) - 9.9) < 1e-9 and max(mine) <= 5.0
    assert sorted({p["x"] for p in points if p["run_id"] == 1}) == [0, 4.9505, 9.9]


def compatible(p, q, near, crossing):
    d, dz = math.hypot(p["x"] - q["x"], p["y"] - q["y"]), abs(p["z"] - q["z"])
    f = abs(math.remainder(p["heading"] - q["heading"], 2 * math.pi))
    f = min(f, abs(math.pi - f))
    return (d <= near and dz <= near and f <= math.radians(25)) or (d <= crossing and dz <= crossing and f >= math.radians(50))


@pytest.mark.parametrize("seed", [1, 2])
def test_places_are_complete_and_maximal(spark, seed):
    """No place holds two poses that do not belong together; no two places could still merge."""
    rng = np.random.default_rng(seed)
    turn = np.cumsum(rng.normal(0, 0.5, 400))
    xy = np.cumsum(0.2 * np.stack([np.cos(turn), np.sin(turn)], axis=1), axis=0) % 4.0
    s = drive(spark, [(x, y, 0.0) for x, y in xy])
    found = {r["spot"]: r.asDict() for r in tp.spots(s).collect()}
    pairs = tp.spot_pairs(tp.spots(s), 0.45, 0.30)
    merges = [(r["a"], r["b"]) for r in tp.complete_link(pairs, 2.0).collect()]
    of = {k: k for k in found}
    for a, b in sorted(merges, reverse=True):
        for k in [k for k, v in of.items() if v == b]:
            of[k] = a
    groups = defaultdict(list)
    for k, v in of.items():
        groups[v].append(found[k])
    assert merges and len(groups) < len(found)
    good = lambda a, b: all(compatible(p, q, 0.45, 0.30) for p in a for q in b)
    lists = list(groups.values())
    for g in lists:
        assert all(good([p], [q]) for p in g for q in g if p["spot"] < q["spot"])
    for k, g in enumerate(lists):
        for h in lists[k + 1:]:
            apart = max(max(q["hi"] for q in h) - min(p["lo"] for p in g), max(p["hi"] for p in g) - min(q["lo"] for q in h))
            assert not (apart >= 2.0 and good(g, h))


def test_parked_drive_has_few_places(spark):
    """Jitter on the spot makes arc without end; the work grows with the spots, not the pairs."""
    n = 60_000
    noise = lambda k, w: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0 - 0.5) * w
    df = spark.range(n).select(
        F.lit(0).cast("long").alias("run_id"), F.col("id").alias("i"), noise(1, 0.1).alias("x"), noise(2, 0.1).alias("y"), noise(3, 0.02).alias("z"),
        noise(4, 0.3).alias("heading"), (F.col("id") * 0.03).alias("s"), F.lit(False).alias("sharp"), F.lit(False).alias("cusp"),
    )
    places = tp.cluster_revisits(df)
    got = places.agg(F.count("*"), F.countDistinct("c")).first()
    assert got[0] == n and got[1] == 1


def test_a_chain_of_near_lanes_does_not_collapse(spark):
    """First and second lane are near, second and third too; first and third are not."""
    lanes = walk((0, 0, 0), (5, 0, 0), (7, 2, 0), (5, 0.4, 0), (0, 0.4, 0), (-2, 2, 0), (0, 0.8, 0), (5, 0.8, 0))
    s = drive(spark, lanes)
    at = s.join(tp.cluster_revisits(s, separation=1.0), ["run_id", "i"]).filter("x > 1.5 AND x < 3.5 AND y < 1").groupBy("c").agg(F.max("y") - F.min("y")).collect()
    assert any(r[1] > 0.3 for r in at) and max(r[1] for r in at) < 0.45


def test_empty_table(spark):
    none = drive(spark, [(0, 0, 0)]).filter("false")
    assert tp.cluster_revisits(none).count() == 0


def test_revisited_components_need_no_pairs(spark):
    """The components of the table of all pairs, which grows with the square of a run, from a few
    links a cell: sparse wanderings beside a stretch driven again and again."""
    import math
    import random

    from drivegrid.operators import graph as gr

    rng, rows = random.Random(3), []
    for run, (n, wide) in enumerate([(500, 12.0), (500, 4.0), (400, 0.5)]):
        for i in range(n):
            rows.append((run, i, rng.random() * wide, rng.random() * wide * (0.1 + 0.9 * (i % 5 == 0)), rng.random() * 0.6, 0.02 * i * (1 + run), rng.uniform(-math.pi, math.pi), i % 97 == 0))
    poses = spark.createDataFrame(rows, "run_id long, i long, x double, y double, z double, s double, heading double, cusp boolean")
    want = gr.revisit_places(gr.revisit_pairs(poses)).select("run_id", "node", "component").collect()
    got = gr.revisit_components(poses).collect()
    assert len(got) == len(want) > 500 and len({(r.run_id, r.component) for r in want}) > 5
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
