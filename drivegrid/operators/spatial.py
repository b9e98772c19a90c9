"""Lines, polygons and bodies against cells and each other.

Every pairing is an equi-join on grid buckets followed by an exact test; results are
aggregated per object, so pairs are never kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.functions import geom2d as G
from drivegrid.functions import vec as V
from drivegrid.functions.evidence import recommended_speed
from drivegrid.functions.num import clamp, reason_codes
from drivegrid.lib import ordered as O
from drivegrid.lib import rings as R
from drivegrid.lib.buckets import broadcast_if_small, bucket, cover_box, is_few
from drivegrid.operators import polylines as pl
from drivegrid.operators.cells import CELL, with_grid
from drivegrid.operators.trajectory import arc_length
from drivegrid.session import cut_lineage

EDGE = pl.EDGE
# lines of at most this many rows compare all their segments, longer ones those of a cell
SHORT_LINE_ROWS = 256


# --- cells touched by lines --------------------------------------------------------------


def touched_cells(pieces: DataFrame, resolution: float) -> DataFrame:
    """Supercover: every closed cell a short segment (``x, y, x1, y1`` with the grid columns)
    touches, plus ``outside`` when an end or a touched cell leaves the grid. A segment apart from
    the grid has one row, without a cell."""
    ox, oy = F.col("origin_x"), F.col("origin_y")
    at = {
        "_ax": G.cell_of(F.col("x"), ox, resolution), "_ay": G.cell_of(F.col("y"), oy, resolution),
        "_bx": G.cell_of(F.col("x1"), ox, resolution), "_by": G.cell_of(F.col("y1"), oy, resolution),
    }
    out_of = lambda a, n: (F.col(a) < 0) | (F.col(a) >= F.col(n))
    p = pieces.withColumns(at)
    p = p.withColumn("_out", out_of("_ax", "width") | out_of("_ay", "height") | out_of("_bx", "width") | out_of("_by", "height"))
    # a piece apart from the grid is one row without a cell
    apart = lambda a, b, n: (F.greatest(a, b) < -1) | (F.least(a, b) > F.col(n))
    p = p.withColumn("_far", apart("_ax", "_bx", "width") | apart("_ay", "_by", "height"))
    none = F.array(F.lit(None).cast("long"))
    span = lambda a, b: F.when(F.col("_far"), none).otherwise(F.sequence(F.least(a, b) - 1, F.greatest(a, b) + 1))
    p = p.withColumn("cx", F.explode(span("_ax", "_bx"))).withColumn("cy", F.explode(span("_ay", "_by")))
    hit = G.segment_hits_cell((F.col("x"), F.col("y")), (F.col("x1"), F.col("y1")), F.col("cx"), F.col("cy"), ox, oy, resolution)
    p = p.filter(F.col("_far") | hit)
    beyond = out_of("cx", "width") | out_of("cy", "height")
    return p.withColumn("outside", F.col("_far") | F.col("_out") | beyond).drop("_ax", "_ay", "_bx", "_by", "_out", "_far")


def trace_lines(lines: DataFrame, cells: DataFrame, grid: DataFrame, resolution: float, keys=EDGE) -> DataFrame:
    """Per line: does it leave the grid, cross an obstacle, cross unknown space. ``cells``:
    obstacle, unknown; a cell without a row is unknown."""
    seg = pl.dense_segments(lines, 0.5 * resolution, keys)
    t = touched_cells(with_grid(seg, grid), resolution)
    # many pieces touch the same cell: one row per line and cell before the join, one for all
    # cells beyond the grid
    within = (F.col("cx") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") >= 0) & (F.col("cy") < F.col("height"))
    t = t.withColumns({a: F.when(within, F.col(a)) for a in ("cx", "cy")})
    t = t.groupBy(*keys, "cx", "cy").agg(F.bool_or("outside").alias("outside"))
    j = t.join(cells.select(*CELL, "obstacle", "unknown"), CELL, "left")
    unknown = F.coalesce("unknown", F.lit(True)) & ~F.coalesce("obstacle", F.lit(False))
    return j.groupBy(*keys).agg(
        F.bool_or("outside").alias("outside"), F.bool_or(F.coalesce("obstacle", F.lit(False))).alias("occupied"),
        F.bool_or(unknown).alias("unknown"),
    )


def lateral_clearance(samples: DataFrame, cells: DataFrame, grid: DataFrame, resolution: float, half_width: float = 3.0, ray_step: float = 0.05, margin: float = 0.05, enforce_unknown: bool = True, keys=EDGE) -> DataFrame:
    """Free width to the left and right of each vertex: rays along the normals, piece by
    piece; inside a piece leaving the grid beats unknown beats obstacle.

    Leaving the grid gives 0; unknown and obstacle give the start of their piece minus the
    margin; only an obstacle or a full ray counts as observed.
    """
    step = min(ray_step, 0.5 * resolution)
    pieces = max(1, math.ceil(half_width / step))
    n = O.with_neighbours(samples, keys, "i", ["x", "y"])
    dx = F.coalesce("x_n1", "x") - F.coalesce("x_p1", "x")
    dy = F.coalesce("y_n1", "y") - F.coalesce("y_p1", "y")
    n = n.withColumns({"_dx": dx, "_dy": dy}).withColumn("_len", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    unit = lambda c: F.when(F.col("_len") < 1e-12, F.lit(0.0)).otherwise(F.col(c) / F.col("_len"))
    n = n.withColumns({"tx": unit("_dx"), "ty": unit("_dy")}).select(*keys, "i", F.col("x").alias("_px"), F.col("y").alias("_py"), "tx", "ty")
    side = F.explode(F.array(F.struct(F.lit("left").alias("side"), (-F.col("ty")).alias("nx"), F.col("tx").alias("ny")),
                             F.struct(F.lit("right").alias("side"), F.col("ty").alias("nx"), (-F.col("tx")).alias("ny"))))
    rays = n.withColumn("r", side).select(*keys, "i", "_px", "_py", "r.side", "r.nx", "r.ny")
    ray = [*keys, "i", "side"]
    p = with_grid(rays, grid).withColumn("piece", F.explode(F.sequence(F.lit(1), F.lit(pieces))))
    far = lambda k: F.lit(half_width) * k.cast("double") / pieces
    d0, d1 = far(F.col("piece") - 1), far(F.col("piece"))
    p = p.withColumns({
        "x": F.col("_px") + F.col("nx") * d0, "y": F.col("_py") + F.col("ny") * d0,
        "x1": F.col("_px") + F.col("nx") * d1, "y1": F.col("_py") + F.col("ny") * d1,
    })
    t = touched_cells(p, resolution)
    known = cells.select(*CELL, "obstacle", "unknown")
    few = is_few(known)
    t = t.select(*ray, "cx", "cy", "piece", F.when(F.col("outside"), F.col("piece")).alias("out_piece"))
    # cells that fit every task come to the rays, which then stay where their vertices are;
    # otherwise a ray asks for each cell once
    if not few:
        t = t.groupBy(*ray, "cx", "cy").agg(F.min("piece").alias("piece"), F.min("out_piece").alias("out_piece"))
    j = t.join(F.broadcast(known) if few else known, CELL, "left")
    obstacle = F.coalesce("obstacle", F.lit(False))
    unknown = F.coalesce("unknown", F.lit(True)) & ~obstacle
    kind = F.when(unknown, 1).when(obstacle, 2) if enforce_unknown else F.when(obstacle, 2)
    # (piece, kind) as one number: the smallest struct would be sorted for
    hit = F.least(F.col("piece") * 3 + kind, F.col("out_piece") * 3)
    sides = ("left", "right")
    best = j.groupBy(*keys, "i").agg(*[F.min(F.when(F.col("side") == s, hit)).alias(f"_{s}") for s in sides])
    k, at = (lambda s: F.col(f"_{s}") % 3), (lambda s: far(F.floor(F.col(f"_{s}") / 3) - 1))
    dist = lambda s: F.when(k(s).isNull(), F.lit(half_width)).when(k(s) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), at(s) - margin))
    return best.select(
        *keys, "i", *[dist(s).alias(f"{s}_clearance") for s in sides], *[(k(s).isNull() | (k(s) == 2)).alias(f"{s}_observed") for s in sides]
    )


def edge_summary(samples: DataFrame, min_width: float = 0.20, speed_limit: float = 1.0, curvature: DataFrame | None = None, keys=EDGE) -> DataFrame:
    """Narrowest width, share of observed boundaries, completeness and speed of each edge."""
    width = F.col("left_clearance") + F.col("right_clearance")
    seen = F.col("left_observed").cast("int") + F.col("right_observed").cast("int")
    out = samples.groupBy(*keys).agg(
        F.min(width).alias("min_width"), (F.sum(seen) / (F.count("*") * 2)).alias("confidence"),
        F.bool_and(F.col("left_observed") & F.col("right_observed")).alias("clearance_complete"),
        F.count_if(width < min_width).alias("narrow_samples"),
    ).withColumn("passable", F.col("narrow_samples") == 0)
    if curvature is not None:
        out = out.join(curvature, list(keys), "left").withColumn(
            "speed", recommended_speed(F.lit(speed_limit), F.coalesce("max_curvature", F.lit(0.0)))
        )
    return out


def corridor_points(samples: DataFrame) -> DataFrame:
    """Boundary points beside each vertex (needs tx, ty, clearances)."""
    lx, ly = -F.col("ty"), F.col("tx")
    return samples.withColumns({
        "left_x": F.col("x") + lx * F.col("left_clearance"), "left_y": F.col("y") + ly * F.col("left_clearance"),
        "right_x": F.col("x") - lx * F.col("right_clearance"), "right_y": F.col("y") - ly * F.col("right_clearance"),
    })


def self_intersections(lines: DataFrame, keys=EDGE, closed: bool = False, size: float = 1.0) -> DataFrame:
    """Lines (or rings) of which two non-adjacent segments touch: ``crossings`` counts the
    distinct segment that starts the crossing.  Long segments lie in many cells, so a line
    measured to be short is compared as a whole."""
    n = O.with_neighbours(lines, keys, "i", ["x", "y"], back=0, ahead=1)
    ends = lines.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "i").alias("_a"), F.count("*").alias("_n"))
    n = n.join(ends, list(keys))
    if closed:
        n = n.withColumns({"x_n1": F.coalesce("x_n1", "_a.x"), "y_n1": F.coalesce("y_n1", "_a.y")})
    seg = n.filter(F.col("x_n1").isNotNull()).select(*keys, "i", "_n", "x", "y", F.col("x_n1").alias("x1"), F.col("y_n1").alias("y1"))
    lo, hi = (lambda a, b: F.least(F.col(a), F.col(b)) - 1e-9), (lambda a, b: F.greatest(F.col(a), F.col(b)) + 1e-9)
    meet = list(keys)
    rows = O.bound_of(lines, "i")
    if rows is None or rows > SHORT_LINE_ROWS:
        seg = cover_box(seg, lo("x", "x1"), hi("x", "x1"), lo("y", "y1"), hi("y", "y1"), size)
        meet += ["_bx", "_by"]
    other = seg.select(*meet, *[F.col(c).alias(f"o_{c}") for c in ("i", "x", "y", "x1", "y1")])
    j = seg.join(other, meet).filter(F.col("o_i") > F.col("i") + 1)
    if closed:
        j = j.filter(~((F.col("i") == 0) & (F.col("o_i") == F.col("_n") - 1)))
    c = F.col
    j = j.filter(
        (F.least("x", "x1") <= F.greatest("o_x", "o_x1") + 1e-9) & (F.least("o_x", "o_x1") <= F.greatest("x", "x1") + 1e-9)
        & (F.least("y", "y1") <= F.greatest("o_y", "o_y1") + 1e-9) & (F.least("o_y", "o_y1") <= F.greatest("y", "y1") + 1e-9)
    )
    hit = G.segments_intersect((c("x"), c("y")), (c("x1"), c("y1")), (c("o_x"), c("o_y")), (c("o_x1"), c("o_y1")))
    per = j.filter(hit).groupBy(*keys, "i").agg(F.lit(1).alias("one"))
    return per.groupBy(*keys).agg(F.count("*").alias("crossings"), F.min("i").alias("first_i"))


# --- polygons ------------------------------------------------------------------------------


def ring_edges(rings: DataFrame, ring_keys) -> DataFrame:
    """Directed edges of closed rings (``ring_keys.., i, x, y``) with the ring's x extent."""
    n = O.with_neighbours(rings, ring_keys, "i", ["x", "y"], back=0, ahead=1)
    box = rings.groupBy(*ring_keys).agg(
        F.min_by(F.struct("x", "y"), "i").alias("_a"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"),
    )
    return n.join(box, list(ring_keys)).select(
        *ring_keys, "i", F.col("x").alias("px"), F.col("y").alias("py"), F.coalesce("x_n1", "_a.x").alias("qx"),
        F.coalesce("y_n1", "_a.y").alias("qy"), "_x0", "_x1", "_y0", "_y1",
    )


def points_in_polygons(points: DataFrame, rings: DataFrame, point_keys, ring_keys, shared=("run_id",), size: float = 2.0) -> DataFrame:
    """(point, ring) pairs with the point inside or on the border.

    A point has one grid cell and a ring, as one row, those of its box. Pairs are made and
    tested within a call for a cell, and only those that hold leave it."""
    clash = [k for k in ring_keys if k in point_keys and k not in shared]
    if clash:
        raise ValueError(f"rename {clash}: point and ring keys must differ")
    ring_only = [k for k in ring_keys if k not in point_keys]
    p = R.home_cell(points.select(*point_keys, F.col("x").alias("ux"), F.col("y").alias("uy")), "ux", "uy", size)
    schema = ", ".join([f"{k} {t}" for df, names in ((p, point_keys), (rings, ring_only)) for k, t in df.select(*names).dtypes] + ["on_border boolean"])
    cells = cover_rings(R.ring_rows(rings, ring_keys), size)
    return R.meet(p, cells, [*shared, "_bx", "_by"], R.points_inside(list(point_keys), ring_only), schema)


def cover_rings(rows: DataFrame, size: float) -> DataFrame:
    tol = R.TOL
    return cover_box(rows, F.col("_x0") - tol, F.col("_x1") + tol, F.col("_y0") - tol, F.col("_y1") + tol, size)


def polygon_spans(lines: DataFrame, rings: DataFrame, keys=EDGE, ring_key: str = "feature_id", size: float = 2.0) -> DataFrame:
    """Arc intervals of each line that lie inside each polygon (merged): ``keys.., feature_id,
    start_s, end_s``.  ``lines`` carry spatial arc ``s``; rings share ``run_id``."""
    seg = pl.segments(lines, keys, ("s",)).select(
        *keys, "i", "x", "y", F.col("x_n1").alias("x1"), F.col("y_n1").alias("y1"), "s", F.col("s_n1").alias("s1")
    ).filter(F.col("s1") - F.col("s") > 1.0e-12)
    c = F.col
    box = rings.groupBy("run_id", ring_key).agg(F.min("x").alias("u0"), F.max("x").alias("u1"), F.min("y").alias("v0"), F.max("y").alias("v1"))
    lo, hi = (lambda a, b: F.least(c(a), c(b))), (lambda a, b: F.greatest(c(a), c(b)))
    sc = cover_box(seg, lo("x", "x1"), hi("x", "x1"), lo("y", "y1"), hi("y", "y1"), size)
    bc = cover_box(box, c("u0"), c("u1"), c("v0"), c("v1"), size)
    overlap = (lo("x", "x1") <= c("u1")) & (hi("x", "x1") >= c("u0")) & (lo("y", "y1") <= c("v1")) & (hi("y", "y1") >= c("v0"))
    unit = [*keys, "i", ring_key]
    cand = sc.join(bc, ["run_id", "_bx", "_by"]).filter(overlap).select(*unit).distinct()
    # crossings with the ring's edges
    re = ring_edges(rings, ["run_id", ring_key]).select("run_id", ring_key, "px", "py", "qx", "qy")
    rc = cover_box(re, F.least("px", "qx") - 1e-9, F.greatest("px", "qx") + 1e-9, F.least("py", "qy") - 1e-9, F.greatest("py", "qy") + 1e-9, size)
    x = sc.join(rc, ["run_id", "_bx", "_by"])
    rx, ry, sx, sy = c("x1") - c("x"), c("y1") - c("y"), c("qx") - c("px"), c("qy") - c("py")
    ax, ay = c("px") - c("x"), c("py") - c("y")
    den = rx * sy - ry * sx
    t = F.try_divide(ax * sy - ay * sx, den)
    u = F.try_divide(ax * ry - ay * rx, den)
    eps = 1.0e-10
    skew = (F.abs(den) > eps) & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps)
    n2 = rx * rx + ry * ry
    along = (F.abs(den) <= eps) & (F.abs(ax * ry - ay * rx) <= eps) & (n2 > eps)
    ta, tb = F.try_divide(ax * rx + ay * ry, n2), F.try_divide((c("qx") - c("x")) * rx + (c("qy") - c("y")) * ry, n2)
    ok = lambda v: F.when(along & (v >= -eps) & (v <= 1 + eps), clamp(v, 0.0, 1.0))
    ts = F.array_compact(F.array(F.when(skew, clamp(t, 0.0, 1.0)), ok(ta), ok(tb)))
    crossing = x.select(*unit, F.explode(ts).alias("t"))
    base = cand.withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    w = Window.partitionBy(*unit).orderBy("t")
    cuts = base.unionByName(crossing).distinct()
    cuts = cuts.withColumn("_prev", F.lag("t").over(w)).filter(c("_prev").isNull() | (c("t") - c("_prev") >= eps))
    pieces = cuts.withColumn("t1", F.lead("t").over(w)).filter(c("t1") > c("t") + 1.0e-12).select(*unit, c("t").alias("t0"), "t1")
    mid = pieces.join(seg, [*keys, "i"]).withColumn("_m", 0.5 * (c("t0") + c("t1")))
    mid = mid.select(
        *keys, c("i").alias("seg_i"), c(ring_key).alias("_want"), "t0", "t1", "s", "s1",
        (c("x") + (c("x1") - c("x")) * c("_m")).alias("x"), (c("y") + (c("y1") - c("y")) * c("_m")).alias("y"),
    )
    pk = [*keys, "seg_i", "_want", "t0", "t1", "s", "s1"]
    inside = points_in_polygons(mid, rings, pk, ["run_id", ring_key], size=size).filter(c("_want") == c(ring_key))
    from drivegrid.operators.intervals import merge_spans

    spans = inside.select(*keys, ring_key, (c("s") + c("t0") * (c("s1") - c("s"))).alias("start_s"), (c("s") + c("t1") * (c("s1") - c("s"))).alias("end_s"))
    return merge_spans(spans, [*keys, ring_key])


def polygon_overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float = 2.0) -> DataFrame:
    """(a, b) ring pairs of a run that share any point: a vertex of one inside the other or
    crossing borders."""
    rows = lambda df, key: cover_rings(R.ring_rows(df, ["run_id", key]), size)
    ids = dict(a.dtypes) | dict(b.dtypes)
    schema = ", ".join(f"{k} {ids[k]}" for k in ("run_id", a_key, b_key))
    return R.meet(rows(a, a_key), rows(b, b_key), ["run_id", "_bx", "_by"], R.overlapping(["run_id"], a_key, b_key, size), schema)


def polygon_contained(a: DataFrame, b: DataFrame, a_key: str, b_key: str, step: float = 0.05, size: float = 2.0) -> DataFrame:
    """(a, b) pairs where every boundary sample of ring a (at most ``step`` apart) is in b."""
    ids = dict(a.dtypes) | dict(b.dtypes)
    schema = ", ".join(f"{k} {ids[k]}" for k in ("run_id", a_key, b_key))
    # ring b covers a's lower corner if it holds a
    inner = R.home_cell(R.ring_rows(a, ["run_id", a_key]), "_x0", "_y0", size)
    return R.meet(inner, cover_rings(R.ring_rows(b, ["run_id", b_key]), size), ["run_id", "_bx", "_by"], R.contained(["run_id"], a_key, b_key, step), schema)


# --- nearest lines ---------------------------------------------------------------------------


#: Where a point meets segments: it has one bucket, so the join's partitioning serves every
#: aggregation per point, and pairs are never shuffled.
MEETING = ["run_id", "_bx", "_by", "anchor_id"]


#: Points of a cell where points meet segments: a segment is copied to each cell of its box, which
#: costs far more than to test it against some points that are not near.
CELL_POINTS = 64


def meeting_size(points: DataFrame, radius: float) -> float:
    """Side of the cells in which points meet segments, as large as the points are sparse."""
    span = lambda a: F.greatest(F.max(a) - F.min(a), F.lit(0.05))
    area, n = points.groupBy("run_id").agg((span("x") * span("y")).alias("a"), F.count("*").alias("n")).agg(F.sum("a"), F.sum("n")).first()
    sparse = math.sqrt(CELL_POINTS * area / n) if n and area is not None and math.isfinite(area) else 0.0
    return max(2.0 * radius, 0.05, sparse)


def near_pairs(points: DataFrame, seg: DataFrame, radius: float, planar: bool = False, within: Column | None = None, size: float | None = None) -> DataFrame:
    """All (point, segment) pairs within ``radius`` (or the point's own ``within``, not larger), with
    the columns of ``MEETING``: closest distance and its arc position and height."""
    size = meeting_size(points, radius) if size is None else size
    lo, hi = (lambda a, b: F.least(a, b) - radius), (lambda a, b: F.greatest(a, b) + radius)
    cov = cover_box(seg, lo("x", "x1"), hi("x", "x1"), lo("y", "y1"), hi("y", "y1"), size)
    own = [] if within is None else [within.alias("_within")]
    p = points.select("run_id", "anchor_id", F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("z").alias("uz"), *own)
    p = p.withColumns({"_bx": bucket(F.col("ux"), size), "_by": bucket(F.col("uy"), size)})
    c = F.col
    dims = "xy" if planar else "xyz"
    far = F.lit(radius) if within is None else c("_within")
    # boxes first: most segments of a bucket are not near the point
    beside = lambda u, a, b: (c(u) >= F.least(c(a), c(b)) - far - 1e-9) & (c(u) <= F.greatest(c(a), c(b)) + far + 1e-9)
    j = p.join(cov, ["run_id", "_bx", "_by"]).filter(beside("ux", "x", "x1") & beside("uy", "y", "y1"))
    j = j.withColumns({f"_d{a}": c(f"{a}1") - c(a) for a in "xyz"})
    n2 = sum((c(f"_d{a}") * c(f"_d{a}") for a in dims[1:]), c("_dx") * c("_dx"))
    along = sum(((c(f"u{a}") - c(a)) * c(f"_d{a}") for a in dims[1:]), (c("ux") - c("x")) * c("_dx"))
    # a generator computes the share once; inlined, it is computed again at each of its uses
    share = F.when(n2 > 1.0e-18, clamp(along / n2, 0.0, 1.0)).otherwise(F.lit(0.0))
    j = j.withColumn("_r", F.explode(F.array(share)))
    off = [c(f"u{a}") - (c(a) + c(f"_d{a}") * c("_r")) for a in dims]
    d = F.sqrt(sum((v * v for v in off[1:]), off[0] * off[0]))
    j = j.withColumns({"distance": d, "arc_s": c("s") + c("_r") * (c("s1") - c("s")), "foot_z": c("z") + c("_dz") * c("_r")})
    j = j.filter(c("distance") <= far)
    return j.select(*MEETING, "edge_id", "i", "distance", "arc_s", "foot_z")


def nearest_segments(points: DataFrame, seg: DataFrame, radius: float, planar: bool = False) -> DataFrame:
    """All (point, edge) pairs within ``radius``: closest distance and its arc position and
    height. ``points``: run_id, anchor_id, x, y, z; ``seg``: run_id, edge_id, i, x..z1, s, s1."""
    return _per_edge(near_pairs(points, seg, radius, planar)).drop("_bx", "_by")


def tied_pairs(points: DataFrame, seg: DataFrame, radius: float, planar: bool = False, slack: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """``run_id, anchor_id, _min`` of the points that have a segment within ``radius``, and their pairs
    not farther than ``_min + slack``. The distances alone are a hash aggregation of numbers; a
    smallest struct of all pairs would be sorted for."""
    key = ["run_id", "anchor_id"]
    size = meeting_size(points, radius)
    low = near_pairs(points, seg, radius, planar, size=size).groupBy(*MEETING).agg(F.min("distance").alias("_min"))
    low = cut_lineage(low.select(*key, "_min"))
    within = F.least(F.lit(radius), F.col("_min") + slack)
    return low, near_pairs(points.join(low, key), seg, radius, planar, within, size)


def _per_edge(pairs):
    best = F.min_by(F.struct("distance", "arc_s", "foot_z"), F.struct("distance", "i"))
    return pairs.groupBy(*MEETING, "edge_id").agg(best.alias("b")).select(*MEETING, "edge_id", "b.*")


def line_segments(lines: DataFrame, keys=EDGE) -> DataFrame:
    """Segments with spatial arc, in the shape ``nearest_segments`` takes."""
    arc = arc_length(lines.select(*keys, "i", "x", "y", "z"), keys)
    s = pl.segments(arc, keys, ("s",))
    return s.select(*keys, "i", "x", "y", "z", "s", *[F.col(f"{a}_n1").alias(f"{a}1") for a in ("x", "y", "z", "s")])


def project_to_graph(anchors: DataFrame, seg: DataFrame, radius: float, exhaustive: bool = False) -> DataFrame:
    """Nearest edge, arc position and whether another edge ties within 1 nm.

    With ``exhaustive`` anchors without an edge in reach are tried again at twice the radius
    until none is left or the whole map is covered, so the search radius is no limit.
    """
    out, todo, r = None, anchors, radius
    key = ["run_id", "anchor_id"]
    while True:
        low, pairs = tied_pairs(todo, seg, r, slack=1.0e-9)
        tied = _per_edge(pairs)
        best = tied.groupBy(*MEETING).agg(
            F.min_by(F.struct("edge_id", "distance", "arc_s"), "edge_id").alias("b"), (F.count("*") > 1).alias("ambiguous")
        ).select(*key, "b.*", "ambiguous")
        out = best if out is None else out.unionByName(best)
        if not exhaustive:
            return out
        todo = todo.join(low, key, "left_anti")
        todo = todo.join(seg.select("run_id").distinct(), "run_id", "left_semi")
        if todo.isEmpty():
            return out
        r *= 2.0


def coverage(line: DataFrame, seg: DataFrame, distance: float, keys=("run_id",)) -> DataFrame:
    """Share of trajectory samples (half ``distance`` apart) within ``distance`` of a segment."""
    keys = list(keys)
    s = pl.densify(line, max(1.0e-3, 0.5 * distance), keys).withColumnRenamed("i", "anchor_id")
    size = max(distance, 0.05)
    cov = cover_box(seg, F.least("x", "x1") - distance, F.greatest("x", "x1") + distance, F.least("y", "y1") - distance, F.greatest("y", "y1") + distance, size)
    near = ["run_id", "_bx", "_by"]
    cov = cov.select(*[F.col(k).alias(f"s{k}") for k in near], F.col("x").alias("px"), F.col("y").alias("py"), F.col("x1").alias("qx"), F.col("y1").alias("qy"))
    p = s.withColumns({"_bx": bucket(F.col("x"), size), "_by": bucket(F.col("y"), size)})
    _, _, _, d = G.project((F.col("px"), F.col("py")), (F.col("qx"), F.col("qy")), (F.col("x"), F.col("y")))
    # a semi join stops at the first segment that is near
    hit = p.join(cov, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"s{k}") for k in near]) & (d <= distance), "left_semi")
    total = s.groupBy(*keys).agg(F.count("*").alias("samples"))
    got = hit.groupBy(*keys).agg(F.count("*").alias("covered"))
    out = total.join(got, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    return out.withColumn("coverage", F.col("covered") / F.col("samples"))


def auto_elevation(queries: DataFrame, seg: DataFrame, points: DataFrame, reach: float = 2.0, radius: float = 1.0, quantile: float = 0.15, min_points: int = 3) -> DataFrame:
    """Height for map clicks (``run_id, anchor_id, x, y``): the nearest route or trajectory
    segment within 2 m, else the lower quantile of the points within 1 m, else NULL."""
    q = queries.select("run_id", "anchor_id", "x", "y", F.lit(0.0).alias("z"))
    found, near = tied_pairs(q, seg, reach, planar=True)
    line = near.groupBy(*MEETING).agg(F.min_by("foot_z", F.struct("edge_id", "i")).alias("_line_z")).drop("_bx", "_by")
    rest = q.join(found, ["run_id", "anchor_id"], "left_anti")
    cov = cover_box(rest, F.col("x") - radius, F.col("x") + radius, F.col("y") - radius, F.col("y") + radius, 2.0 * radius)
    p = points.select("run_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").cast("double").alias("pz"))
    p = p.withColumns({"_bx": bucket(F.col("px"), 2.0 * radius), "_by": bucket(F.col("py"), 2.0 * radius)})
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    j = cov.join(p, ["run_id", "_bx", "_by"]).filter(dx * dx + dy * dy <= radius * radius)
    key = ["run_id", "anchor_id"]
    # heights are counted before they are ordered: a crowded click is a short histogram
    h = j.groupBy(*key, "pz").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    h = h.withColumns({"_cum": F.sum("n").over(w.orderBy("pz").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)})
    rank = F.floor(F.lit(quantile) * (F.col("_all") - 1).cast("double"))
    cloud = h.filter((F.col("_all") >= min_points) & (F.col("_cum") > rank)).groupBy(*key).agg(F.min("pz").alias("_cloud_z"))
    out = q.drop("z").join(line, key, "left").join(cloud, key, "left")
    src = F.when(F.col("_line_z").isNotNull(), "route").when(F.col("_cloud_z").isNotNull(), "points").otherwise("unavailable")
    return out.withColumns({"z": F.coalesce("_line_z", "_cloud_z"), "source": src}).drop("_line_z", "_cloud_z")


# --- bodies against cells -----------------------------------------------------------------


def footprint_overlap(poses: DataFrame, cells: DataFrame, grid: DataFrame, resolution: float, model: str, front: float, rear: float, width: float, keys=EDGE) -> DataFrame:
    """Body at each pose (``keys.., i, x, y, yaw``) against the cells: per pose whether it
    leaves the grid and per (pose, cell) hits on obstacle and unknown cells."""
    circle = model == "circle"
    hw = 0.5 * width
    w = with_grid(poses, grid)
    c, s = F.cos("yaw"), F.sin("yaw")
    half, shift = 0.5 * (front + rear), 0.5 * (front - rear)
    ccx = F.col("x") if circle else F.col("x") + c * shift
    ccy = F.col("y") if circle else F.col("y") + s * shift
    ex = F.lit(hw) if circle else half * F.abs(c) + hw * F.abs(s)
    ey = F.lit(hw) if circle else half * F.abs(s) + hw * F.abs(c)
    w = w.withColumns({"_x0": ccx - ex, "_x1": ccx + ex, "_y0": ccy - ey, "_y1": ccy + ey})
    tol = 1.0e-12
    gx1 = F.col("origin_x") + F.col("width") * resolution
    gy1 = F.col("origin_y") + F.col("height") * resolution
    out = (F.col("_x0") < F.col("origin_x") - tol) | (F.col("_y0") < F.col("origin_y") - tol) | (F.col("_x1") > gx1 + tol) | (F.col("_y1") > gy1 + tol)
    w = w.withColumn("outside", out)
    span = lambda a, b, o: F.sequence(G.cell_of(F.col(a), F.col(o), resolution) - 1, G.cell_of(F.col(b), F.col(o), resolution) + 1)
    t = w.withColumn("cx", F.explode(span("_x0", "_x1", "origin_x"))).withColumn("cy", F.explode(span("_y0", "_y1", "origin_y")))
    mx, my = G.cell_center(F.col("cx"), F.col("origin_x"), resolution), G.cell_center(F.col("cy"), F.col("origin_y"), resolution)
    if circle:
        hit = G.circle_hits_cell(F.col("x"), F.col("y"), hw, mx, my, resolution)
    else:
        hit = G.rectangle_hits_cell(F.col("x"), F.col("y"), F.col("yaw"), front, rear, hw, mx, my, resolution)
    inside = (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") < F.col("height"))
    t = t.filter(hit & (inside | F.col("outside")))
    known = broadcast_if_small(cells.select(*CELL, "obstacle", "unknown"))
    j = t.select(*keys, "i", "cx", "cy", "outside", inside.alias("_in")).join(known, CELL, "left")
    obstacle = F.coalesce("obstacle", F.lit(False)) & F.col("_in")
    unknown = F.coalesce("unknown", F.lit(True)) & F.col("_in") & ~obstacle
    return j.select(*keys, "i", "cx", "cy", "outside", obstacle.alias("obstacle"), unknown.alias("unknown"))


def body_passage_report(overlap: DataFrame, edges: DataFrame, min_turning_radius: float, verified: bool, keys=EDGE) -> DataFrame:
    """Per edge: overlapping samples and cells, first obstacle cell, hard errors, warnings.
    ``edges``: keys.., planar_length, max_curvature, sample_count."""
    pose = overlap.groupBy(*keys, "i").agg(
        F.bool_or("obstacle").alias("o"), F.bool_or("unknown").alias("u"), F.bool_or("outside").alias("x")
    )
    per = pose.groupBy(*keys).agg(
        F.count_if("o").alias("obstacle_samples"), F.count_if(F.col("u") | F.col("x")).alias("unknown_samples"), F.count_if("x").alias("outside_samples")
    )
    cell = overlap.filter(F.col("obstacle") | F.col("unknown")).groupBy(*keys, "cx", "cy").agg(
        F.bool_or("obstacle").alias("o"), F.bool_or("unknown").alias("u"), F.min(F.when(F.col("obstacle"), F.col("i"))).alias("i")
    )
    firsts = F.min(F.when(F.col("o"), F.struct("i", "cy", "cx")))
    cs = cell.groupBy(*keys).agg(F.count_if("o").alias("obstacle_cells"), F.count_if("u").alias("unknown_cells"), firsts.alias("f"))
    out = edges.join(per, list(keys), "left").join(cs, list(keys), "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0).cast("long"))
    names = ["obstacle_samples", "unknown_samples", "outside_samples", "obstacle_cells", "unknown_cells"]
    out = out.withColumns({n: zero(n) for n in names})
    sharp = F.lit(min_turning_radius > 0) & (F.col("max_curvature") > (1.0 / min_turning_radius if min_turning_radius > 0 else 0.0) + 1.0e-9)
    errors = reason_codes(
        ((F.col("sample_count") == 0) | ~(F.col("planar_length") > 1e-12), "route_edge_geometry_invalid"),
        (F.col("obstacle_samples") > 0, "body_footprint_overlaps_obstacle"),
        (F.col("unknown_samples") > 0, "body_footprint_overlaps_unknown"),
        (F.col("outside_samples") > 0, "body_footprint_outside_grid"),
        (sharp & F.lit(verified), "minimum_turning_radius_violation"),
    )
    warn = reason_codes((sharp & F.lit(not verified), "unverified_minimum_turning_radius_violation"))
    return out.select(
        *keys, "sample_count", *names, F.col("f.cx").alias("first_cx"), F.col("f.cy").alias("first_cy"),
        sharp.alias("curvature_violation"), errors.alias("hard_errors"), warn.alias("warnings"), (F.size(errors) == 0).alias("hard_valid"),
    )


def body_passage_totals(report: DataFrame) -> DataFrame:
    ok, warned = F.col("hard_valid"), F.size("warnings") > 0
    return report.groupBy("run_id").agg(
        F.sum("sample_count").alias("total_samples"), F.sum("obstacle_samples").alias("obstacle_samples"),
        F.count_if(~ok).alias("hard_invalid_edges"), F.count_if(ok & warned).alias("warning_edges"), F.count_if(ok & ~warned).alias("valid_edges"),
        (F.count_if(~ok) == 0).alias("planning_body_passage_ready"),
    )


def cell_counts(lines: DataFrame, grid: DataFrame, resolution: float, keys=EDGE) -> DataFrame:
    """Samples of each line per cell, before they meet the cells; all beyond the grid are one row."""
    s = with_grid(pl.densify(lines, 0.25 * resolution, keys), grid)
    s = s.withColumns({"cx": G.cell_of(F.col("x"), F.col("origin_x"), resolution), "cy": G.cell_of(F.col("y"), F.col("origin_y"), resolution)})
    inside = (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") < F.col("height"))
    s = s.withColumn("_in", inside).withColumns({a: F.when(F.col("_in"), F.col(a)) for a in ("cx", "cy")})
    return s.groupBy(*keys, "cx", "cy", "_in").agg(F.count("*").alias("n"))


def route_vs_grid(lines: DataFrame, cells: DataFrame, grid: DataFrame, resolution: float, keys=EDGE) -> DataFrame:
    """Samples a quarter cell apart on obstacle, unknown or no cell of the grid."""
    per = cell_counts(lines, grid, resolution, keys)
    j = per.join(cells.select(*CELL, "obstacle", "unknown"), CELL, "left")
    o = F.coalesce("obstacle", F.lit(False)) & F.col("_in")
    u = F.coalesce("unknown", F.lit(True)) & F.col("_in") & ~o
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return j.groupBy(*keys).agg(n(o).alias("obstacle_samples"), n(u).alias("unknown_samples"), n(~F.col("_in")).alias("off_map_samples"))


def min_lanelet_width(left: DataFrame, right: DataFrame, fractions: int = 100, keys=EDGE) -> DataFrame:
    """Smallest gap between both boundaries at equal shares of their own length."""
    def at(line, p):
        arc = arc_length(line, keys, planar=True)
        tot = arc.groupBy(*keys).agg(F.max("s").alias("_t"))
        t = tot.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(fractions)))).withColumn("t", F.col("_t") * F.col("k") / fractions)
        return pl.sample_at_arc(arc, t.select(*keys, "k", "t"), keys).select(*keys, "k", F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))

    j = at(left, "l").join(at(right, "r"), [*keys, "k"])
    return j.groupBy(*keys).agg(F.min(V.dist2(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))).alias("min_width"))


def stop_line_geometry(stops: DataFrame, lines: DataFrame, keys=EDGE) -> DataFrame:
    """Line across the edge at each stop (``keys.., stop_id, s, width``): centre and ends."""
    arc = arc_length(lines, keys)
    tot = arc.groupBy(*keys).agg(F.max("s").alias("_total"))
    d = 0.05
    want = stops.join(tot, list(keys)).withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    want = want.withColumn("t", clamp(F.col("s") + F.col("_o") * d, 0.0, F.col("_total"))).drop("_total")
    p = pl.sample_at_arc(arc, want.withColumnRenamed("s", "stop_s"), keys)
    pick = lambda o, a: F.max(F.when(F.col("_o") == o, F.col(a)))
    g = p.groupBy(*keys, "stop_id", "width").agg(*[pick(o, a).alias(f"{a}{o + 1}") for o in (-1, 0, 1) for a in "xy"])
    dx, dy = F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")
    g = g.withColumns({"_dx": dx, "_dy": dy}).withColumn("_n", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    nx, ny = -F.try_divide(F.col("_dy"), F.col("_n")), F.try_divide(F.col("_dx"), F.col("_n"))
    h = F.col("width") * 0.5
    return g.select(
        *keys, "stop_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x1") + nx * h).alias("left_x"), (F.col("y1") + ny * h).alias("left_y"),
        (F.col("x1") - nx * h).alias("right_x"), (F.col("y1") - ny * h).alias("right_y"),
    )
