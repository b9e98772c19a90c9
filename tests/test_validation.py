"""Edges against a small map: one case for every verdict."""

import math

import pytest

from drivegrid.operators import corridor as co
from drivegrid.operators import validation as va

RES = 0.25


@pytest.fixture(scope="module")
def checked(spark):
    """A hall of 20 x 10 m, free but for a wall at x = 15 and an unseen strip at y >= 8."""
    lines = {
        1: [(2, 4), (8, 4)],  # free on both sides
        2: [(10, 4), (18, 4)],  # through the wall
        3: [(2, 9), (8, 9)],  # in unknown space
        4: [(2, 7.8), (8, 7.8)],  # its body reaches into unknown space
        5: [(-3, 2), (4, 2)],  # leaves the grid
        6: [(2, 3), (2, 3)],  # no length
        7: [(5, 5), (8, 5), (6.5, 5.02), (4, 5)],  # turns back on itself
        8: [(2, 1.5), (2.3, 1.5)],  # too short
        9: [(4, 2), (6, 2), (6, 4), (5, 4), (5, 1.5)],  # crosses itself
        10: [(3, 6)],  # one vertex
        11: [(14.2, 1), (14.2, 6)],  # beside the wall
        12: [(3 + 2 * math.cos(a / 20), 4 + 2 * math.sin(a / 20)) for a in range(32)],  # a bend
    }
    rows = [(1, e, i, float(x), float(y), 0.0) for e, pts in lines.items() for i, (x, y) in enumerate(pts)]
    line = spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double")
    edges = spark.createDataFrame([(1, e) for e in [*lines, 99]], "run_id long, edge_id long")
    cells = []
    for cx in range(80):
        for cy in range(40):
            wall, unseen = cx in (60, 61), cy >= 32
            if not unseen:
                cells.append((1, cx, cy, wall, False))
    cell = spark.createDataFrame(cells, "run_id long, cx long, cy long, obstacle boolean, unknown boolean")
    grid = spark.createDataFrame([(1, 0.0, 0.0, 80, 40)], "run_id long, origin_x double, origin_y double, width long, height long")
    body = va.Body(front=0.4, rear=0.4, width=0.5, min_turning_radius=1.0)
    out, samples = va.validate_edges(edges, line, cell, grid, RES, body, half_width=1.0, ray_step=0.1)
    return {r["edge_id"]: r.asDict() for r in out.collect()}, samples.collect()


def test_every_verdict(checked):
    got, _ = checked
    codes = {k: set(v["errors"]) for k, v in got.items()}
    assert codes[1] == set() and got[1]["status"] == "VALID" and got[1]["confidence"] == 1.0 and abs(got[1]["min_width"] - 2.0) < 1e-9
    assert {"centerline_occupied", "vehicle_footprint_overlaps_obstacle", "insufficient_clearance"} <= codes[2]
    assert {"centerline_unknown", "unknown_clearance", "vehicle_footprint_overlaps_unknown"} <= codes[3]
    assert codes[4] == {"unknown_clearance", "vehicle_footprint_overlaps_unknown"} and got[4]["passable"]
    assert {"centerline_outside_grid", "centerline_unknown"} <= codes[5]
    assert {"degenerate_tangent", "corridor_degenerate", "edge_below_minimum_length"} <= codes[6]
    assert {"corridor_tangent_reversal", "minimum_turning_radius_violation"} <= codes[7]
    assert codes[8] == {"edge_below_minimum_length"}
    assert "centerline_self_intersection" in codes[9]
    assert codes[10] == {"centerline_too_short", "edge_below_minimum_length"} and codes[99] == codes[10]
    assert codes[11] == set() and 1.0 < got[11]["min_width"] < 2.0
    assert codes[12] == set() and 0.4 < got[12]["max_curvature"] < 0.6
    for k, v in got.items():
        hard = codes[k] - {"unknown_clearance"}
        assert v["status"] == ("INVALID" if hard else "WARNING" if codes[k] else "VALID")


def test_samples_match_brute_force(checked):
    """Free width beside a straight line next to the wall: the wall's face less the margin."""
    _, samples = checked
    mine = [r for r in samples if r["edge_id"] == 11]
    assert len(mine) > 40
    for r in mine:
        # driving up, the wall is to the right at x = 15: the ray's piece that meets it starts at 0.7 or 0.8
        assert r["left_clearance"] == 1.0 and r["left_observed"] and r["right_observed"]
        assert 15.0 - 14.2 - 0.2 <= r["right_clearance"] <= 15.0 - 14.2
        assert abs(r["right_x"] - 14.2 - r["right_clearance"]) < 1e-9 and abs(r["left_x"] - 13.2) < 1e-9


def outline_hits(line, width, front, rear):
    """Offsets of a swept strip, one outline point after the other."""
    s = [0.0]
    for a, b in zip(line, line[1:]):
        s.append(s[-1] + math.dist(a, b))

    def at(t):
        t = min(max(t, 0.0), s[-1])
        k = max(j for j in range(len(s) - 1) if s[j] <= t or j == 0)
        r = (t - s[k]) / (s[k + 1] - s[k])
        return tuple(p + (q - p) * r for p, q in zip(line[k], line[k + 1]))

    capture = max(0.1, 0.5 * max(b - a for a, b in zip(s, s[1:])) + 0.1)
    left, right = [width / 2] * len(line), [width / 2] * len(line)
    n = max(1, math.ceil(s[-1] / 0.1))
    for k in range(n + 1):
        t = s[-1] * k / n
        (px, py), a, b = at(t), at(t - 0.25), at(t + 0.25)
        d = math.dist(a, b)
        ux, uy = (b[0] - a[0]) / d, (b[1] - a[1]) / d
        for along, across in co.outline(width, front, rear):
            x, y = px + ux * along - uy * across, py + uy * along + ux * across
            for j, (cx, cy) in enumerate(line):
                if not -(rear + capture) <= s[j] - t <= front + capture:
                    continue
                p, q = line[max(j - 1, 0)], line[min(j + 1, len(line) - 1)]
                e = math.dist(p, q)
                tx, ty = (q[0] - p[0]) / e, (q[1] - p[1]) / e
                ahead, side = (x - cx) * tx + (y - cy) * ty, (y - cy) * tx - (x - cx) * ty
                cap = j == 0 and -(rear + 0.05) <= ahead <= 0 or j == len(line) - 1 and 0 <= ahead <= front + 0.05
                if cap or abs(ahead) <= capture:
                    left[j], right[j] = max(left[j], side), max(right[j], -side)
    wide = lambda v: [max(v[max(j - 1, 0):j + 2]) + 0.05 for j in range(len(v))]
    return wide(left), wide(right)


def test_swept_strip_matches_brute_force(spark):
    bend = [(2 * math.cos(a / 8), 2 * math.sin(a / 8)) for a in range(14)]
    straight = [(0.3 * k, 0.0) for k in range(10)]
    loop = [(3 * math.cos(math.pi * a / 30), 3 * math.sin(math.pi * a / 30)) for a in range(60)]
    rows = [(1, e, i, x, y, 0.0) for e, line in ((1, bend), (2, straight), (3, loop + loop[:1])) for i, (x, y) in enumerate(line)]
    got = co.swept_corridor(spark.createDataFrame(rows, "run_id long, edge_id long, i long, x double, y double, z double"), 0.8, 1.0, 0.4).collect()
    by = {(r["edge_id"], r["i"]): r for r in got}
    for e, line in ((1, bend), (2, straight)):
        left, right = outline_hits(line, 0.8, 1.0, 0.4)
        for j in range(len(line)):
            assert abs(by[e, j]["left_offset"] - left[j]) < 1e-9 and abs(by[e, j]["right_offset"] - right[j]) < 1e-9
    ends = by[2, 0], by[2, 9]
    assert abs(ends[0]["left_x"] + 0.45) < 1e-9 and abs(ends[1]["left_x"] - (2.7 + 1.05)) < 1e-9
    # on a loop the strip is the same all around, through the seam too, and wider outside the bend
    offs = [(r["left_offset"], r["right_offset"]) for (e, _), r in by.items() if e == 3]
    assert max(a for a, _ in offs) - min(a for a, _ in offs) < 0.02 and max(b for _, b in offs) - min(b for _, b in offs) < 0.02
    assert len(offs) == 61 and min(b for _, b in offs) > max(a for a, _ in offs) + 0.05
