"""Operators on ordered polylines: rows ``keys.., i, x, y, z`` with dense ``i``.

Edges use the keys ``run_id, edge_id``; a drive itself is the polyline of ``run_id``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.functions import geom2d as G
from drivegrid.functions import vec as V
from drivegrid.functions.num import clamp, finite
from drivegrid.lib import ordered as O
from drivegrid.lib.buckets import bucket
from drivegrid.operators.trajectory import arc_length, choose_apart
from drivegrid.session import cut_lineage

EDGE = ["run_id", "edge_id"]

# fixed values: tolerances that are part of the results
SNAP_M = 0.001 + 1.0e-9
ZERO_ARC = 1.0e-12
EXCURSION_MAX_M = 0.50
EXCURSION_MIN_TURN = math.radians(75.0)
CHORD_ERROR_M = 0.05
CHORD_PIECE_M = 0.50
# segments a row sees before and after its own
SIGHT = 2


def segments(line: DataFrame, keys=EDGE, extra=()) -> DataFrame:
    """One row per segment: vertex columns plus ``*_n1`` of the next vertex."""
    out = O.with_neighbours(line, keys, "i", ["x", "y", "z", *extra], back=0, ahead=1)
    return out.filter(F.col("x_n1").isNotNull())


def drop_consecutive_duplicates(line: DataFrame, keys=EDGE, eps: float = 1.0e-6) -> DataFrame:
    """Drop vertices not farther than ``eps`` from the one before; positions stay dense."""
    near = O.with_neighbours(line, keys, "i", ["x", "y", "z"], back=1, ahead=0)
    d = V.dist3((F.col("x_p1"), F.col("y_p1"), F.col("z_p1")), V.vec())
    kept = near.filter(F.col("x_p1").isNull() | (d > eps)).drop("x_p1", "y_p1", "z_p1")
    return O.reindex(kept, keys, "i")


def heading_changes(line: DataFrame, keys=EDGE) -> DataFrame:
    """``heading`` (central difference, one-sided at the ends) and ``turn`` per vertex."""
    n = O.with_neighbours(line, keys, "i", ["x", "y"])
    c = F.col
    a = lambda k: F.coalesce(c(f"{k}_p1"), c(k))
    b = lambda k: F.coalesce(c(f"{k}_n1"), c(k))
    turn = V.turn_angle(c("x_p1"), c("y_p1"), c("x"), c("y"), c("x_n1"), c("y_n1"))
    return n.withColumns(
        {"heading": F.atan2(b("y") - a("y"), b("x") - a("x")), "turn": F.coalesce(turn, F.lit(0.0))}
    ).drop("x_p1", "y_p1", "x_n1", "y_n1")


def cut_pieces(line: DataFrame, max_step: float, keys, planar: bool, back: int = 0, extra=()) -> DataFrame:
    """Vertices with ``*_n1`` of the next one (``*_p1`` of the one before, if asked) and the number
    of pieces not longer than ``max_step`` of their segment (1 at the last vertex)."""
    n = O.with_neighbours(line, keys, "i", ["x", "y", "z", *extra], back=back, ahead=1)
    return n.withColumn("_pieces", F.coalesce(_pieces_of("", "_n1", max_step, planar), F.lit(1).cast("long")))


def _pieces_of(a: str, b: str, max_step: float, planar: bool) -> Column:
    one, two = (tuple(F.col(f"{v}{end}") for v in "xyz") for end in (a, b))
    length = V.dist2(*one[:2], *two[:2]) if planar else V.dist3(one, two)
    return F.greatest(F.lit(1).cast("long"), F.ceil(length / F.lit(max_step)))


def _share(a: Column, b: Column, k: Column, n: Column) -> Column:
    # multiplied first: a share k / n rounded by itself moves points off a cell border
    return a + (b - a) * k / n


def _exploded(n: DataFrame) -> DataFrame:
    return n.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))


def _dense_at(axes="xyz") -> list[Column]:
    """Columns of the dense points ``_k`` of their segments."""
    return [_share(F.col(a), F.coalesce(f"{a}_n1", a), F.col("_k"), F.col("_pieces")).alias(a) for a in axes]


def densify(line: DataFrame, max_step: float, keys=EDGE, planar: bool = True) -> DataFrame:
    """Keep every vertex and insert evenly spaced points; dense positions are computed from
    the running number of pieces, so nothing is sorted again."""
    n = cut_pieces(line, max_step, keys, planar)
    n = O.running(n, keys, "i", {"_upto": ("sum", F.col("_pieces"))})
    return _exploded(n).select(*keys, (F.col("_upto") - F.col("_pieces") + F.col("_k")).alias("i"), *_dense_at())


def dense_segments(line: DataFrame, max_step: float, keys=EDGE, planar: bool = True) -> DataFrame:
    """The segments between consecutive points of ``densify``: ``keys.., x, y, x1, y1``. Both ends
    of a piece lie on one segment, so the dense points never meet each other in a shuffle."""
    n = cut_pieces(line, max_step, keys, planar).filter(F.col("x_n1").isNotNull())
    k, more = F.col("_k"), F.col("_k") + 1 < F.col("_pieces")
    end = lambda a: F.when(more, _share(F.col(a), F.col(f"{a}_n1"), k + 1, F.col("_pieces"))).otherwise(F.col(f"{a}_n1"))
    return _exploded(n).select(*keys, *_dense_at(axes="xy"), end("x").alias("x1"), end("y").alias("y1"))


def waypoints(line: DataFrame, max_step: float, closed: bool = False, keys=EDGE) -> DataFrame:
    """``waypoint_yaw`` of ``densify`` (3-D steps). The next point lies on the same segment; only the
    last vertex looks back, at the last piece of the segment before."""
    c = F.col
    n = cut_pieces(line, max_step, keys, False, back=1)
    n = O.running(n, keys, "i", {"_upto": ("sum", c("_pieces"))})
    back = F.coalesce(_pieces_of("_p1", "", max_step, False), F.lit(1).cast("long"))
    before = [_share(c(f"{a}_p1"), c(a), back - 1, back) for a in "xy"]
    to = lambda ax, ay, bx, by: F.atan2(by - ay, bx - ax)
    last = F.coalesce(to(*before, c("x"), c("y")), F.lit(0.0))
    if closed:
        ends = line.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "i").alias("_a"))
        n = n.join(ends, list(keys))
        apart = V.dist2(c("x"), c("y"), c("_a.x"), c("_a.y")) > 1.0e-9
        last = F.when(apart, to(c("x"), c("y"), c("_a.x"), c("_a.y"))).otherwise(last)
    n = n.withColumn("_last", F.when(c("x_n1").isNull(), last))
    k, more = c("_k"), c("_k") + 1 < c("_pieces")
    nx, ny = (F.when(more, _share(c(a), c(f"{a}_n1"), k + 1, c("_pieces"))).otherwise(c(f"{a}_n1")) for a in "xy")
    x, y = (_share(c(a), c(f"{a}_n1"), k, c("_pieces")) for a in "xy")
    yaw = F.when(c("x_n1").isNull(), c("_last")).otherwise(to(x, y, nx, ny))
    return _exploded(n).select(*keys, (c("_upto") - c("_pieces") + k).alias("i"), *_dense_at(), yaw.alias("yaw"))


def arc_buckets(line: DataFrame, keys, size: float) -> DataFrame:
    """``keys.., _total, _size`` per line: its length, and a bucket of arc that is not shorter than
    its mean segment, so that segments of any length have no more than two copies on average."""
    total = F.max("s")
    mean = total / F.count("*")
    return line.groupBy(*keys).agg(total.alias("_total"), F.when(mean > size, mean).otherwise(F.lit(float(size))).alias("_size"))


def in_buckets(a: str, b: str) -> Column:
    """The arc buckets from ``a`` to ``b``, one copy of the row for each."""
    at = lambda v: F.floor(F.col(v) / F.col("_size"))
    return F.explode(F.sequence(at(a), at(b)))


def sample_at_arc(line: DataFrame, targets: DataFrame, keys=EDGE, size: float = 1.0, values=("x", "y", "z"), flags=(), keep=()) -> DataFrame:
    """Interpolated point at arc ``t`` of each target row (``keys.., t, ...``), clamped to the
    line.  ``line`` carries ``s``.  Segments and targets meet in arc buckets, so neither a long
    edge nor an edge with very many targets ends up in one task.  ``flags`` (booleans) hold
    only if both ends do.  ``keep`` names columns of the segment (``i``) or its line (``_total``)."""
    cols = [*values, *flags, "s"]
    seg = O.with_neighbours(line.select(*keys, "i", *cols), keys, "i", cols, back=0, ahead=1)
    seg = seg.filter(F.col("s_n1").isNotNull())
    of = arc_buckets(line, keys, size)
    seg = seg.join(of.select(*keys, "_size"), list(keys)).withColumn("_b", in_buckets("s", "s_n1")).drop("_size")
    want = targets.join(of, list(keys)).withColumn("_t", clamp(F.col("t"), 0.0, F.col("_total")))
    want = want.withColumn("_b", F.floor(F.col("_t") / F.col("_size"))).drop("_size")
    t, s0, s1 = F.col("_t"), F.col("s"), F.col("s_n1")
    m = want.join(seg, [*keys, "_b"]).filter(((t > s0) & (t <= s1)) | ((F.col("i") == 0) & (t <= 0.0)))
    span = s1 - s0
    r = F.when(span > 1.0e-12, (t - s0) / span).otherwise(F.lit(0.0))
    m = m.withColumn("_ratio", r)
    ratio = F.col("_ratio")
    out = [(F.col(v) + (F.col(f"{v}_n1") - F.col(v)) * ratio).alias(v) for v in values]
    at0, at1 = ratio <= 1.0e-12, ratio >= 1.0 - 1.0e-12
    out += [
        F.when(at0, F.col(f)).when(at1, F.col(f"{f}_n1")).otherwise(F.col(f) & F.col(f"{f}_n1")).alias(f)
        for f in flags
    ]
    return m.select(*targets.columns, *keep, *out)


def slice_lines(line: DataFrame, spans: DataFrame, keys=EDGE, slice_key="slice_id", eps: float = 1.0e-9, size: float = 1.0, values=("x", "y", "z"), flags=()) -> DataFrame:
    """Polyline of every span (``keys.., slice_id, s0, s1``): interpolated ends, original
    vertices strictly inside. Rows ``keys.., slice_id, i, s, values``."""
    ends = spans.select(*keys, slice_key, F.explode(F.array(F.struct(F.lit(0).alias("_o"), F.col("s0").alias("t")), F.struct(F.lit(2).alias("_o"), F.col("s1").alias("t")))).alias("e"))
    ends = ends.select(*keys, slice_key, "e._o", "e.t")
    tips = sample_at_arc(line, ends, keys, size, values, flags).withColumnRenamed("t", "s")
    of = arc_buckets(line, keys, size).select(*keys, "_size")
    cover = spans.join(of, list(keys)).withColumn("_b", in_buckets("s0", "s1"))
    at = F.floor(F.col("s") / F.col("_size"))
    inner = line.join(of, list(keys)).withColumn("_b", at).drop("_size").join(cover.select(*keys, slice_key, "s0", "s1", "_b"), [*keys, "_b"])
    inner = inner.filter((F.col("s") > F.col("s0") + eps) & (F.col("s") < F.col("s1") - eps))
    # inner vertices are consecutive, so one count per slice gives every position
    per = inner.groupBy(*keys, slice_key).agg(F.min("i").alias("_lo"), F.count("*").alias("_inner"))
    cols = [*keys, slice_key, "i", "s", *values, *flags]
    ends_i = F.when(F.col("_o") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("_inner", F.lit(0)) + 1)
    tips = tips.join(per, [*keys, slice_key], "left").withColumn("i", ends_i).select(*cols)
    inner = inner.join(per, [*keys, slice_key]).withColumn("i", F.col("i") - F.col("_lo") + 1).select(*cols)
    return tips.unionByName(inner)


def smooth_by_arc(line: DataFrame, window: float, keys=EDGE, passes: int = 2) -> DataFrame:
    """Triangular kernel over arc distance <= window / 2, run twice; ends stay, a closed loop
    wraps around (its first point stays).

    The kernel is linear in arc, so two RANGE frames with plain and arc-weighted sums give it
    exactly; frames work inside arc chunks with copied borders.
    """
    r = 0.5 * window
    if not r > 0:
        return line
    ends = line.groupBy(*keys).agg(
        F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("x", "y"), "i").alias("b"), F.max("i").alias("_last")
    ).withColumn("_closed", V.dist2(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) <= 1.0e-6).select(*keys, "_last", "_closed")
    out = line.select(*keys, "i", "x", "y", "z")
    for _ in range(passes):
        out = _kernel_pass(out, ends, keys, r)
    return out


def _kernel_pass(line, ends, keys, r):
    arc = arc_length(line, keys, planar=True).join(ends, keys)
    total = arc.groupBy(*keys).agg(F.max("s").alias("_total"))
    arc = arc.join(total, keys)
    body = arc.filter(~F.col("_closed") | (F.col("i") < F.col("_last")))
    shift = F.when(F.col("_closed"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    wrapped = body.withColumn("_turn", F.explode(shift)).withColumn("_s", F.col("s") + F.col("_turn") * F.col("_total"))
    wrapped = wrapped.filter((F.col("_turn") == 0) | ((F.col("_s") >= -r) & (F.col("_s") <= F.col("_total") + r)))
    size = 1000.0 * r
    home = bucket(F.col("_s"), size)
    copies = F.array_distinct(F.array(bucket(F.col("_s") - r, size), home, bucket(F.col("_s") + r, size)))
    spread = wrapped.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    part = ", ".join([*keys, "_chunk"])
    over = {
        "l": f"RANGE BETWEEN {r!r}D PRECEDING AND CURRENT ROW",
        "g": f"RANGE BETWEEN CURRENT ROW AND {r!r}D FOLLOWING",
        "e": "RANGE BETWEEN CURRENT ROW AND CURRENT ROW",
    }
    sums = {}
    for f, frame in over.items():
        for name, expr in (("1", "1D"), ("s", "_s"), *[(a, a) for a in "xyz"], *[(f"s{a}", f"_s * {a}") for a in "xyz"]):
            sums[f"_{f}_{name}"] = F.expr(f"sum({expr}) OVER (PARTITION BY {part} ORDER BY _s {frame})")
    w = spread.withColumns(sums).filter((F.col("_chunk") == F.col("_home")) & (F.col("_turn") == 0))
    c = F.col

    def kernel(plain, weighted):
        left = (1.0 - c("_s") / r) * c(f"_l_{plain}") + c(f"_l_{weighted}") / r
        right = (1.0 + c("_s") / r) * c(f"_g_{plain}") - c(f"_g_{weighted}") / r
        return left + right - c(f"_e_{plain}")

    w = w.withColumn("_w", kernel("1", "s"))
    keep = (c("i") == 0) | (~c("_closed") & (c("i") == c("_last"))) | (c("_last") < 2) | ~(c("_total") > 1.0e-9) | (c("_w") <= 1.0e-12)
    new = w.select(
        *keys, "i", *[F.when(keep, c(a)).otherwise(kernel(a, f"s{a}") / c("_w")).alias(a) for a in "xyz"]
    )
    # the closing vertex of a loop repeats the first one
    close = arc.filter(c("_closed") & (c("i") == c("_last"))).select(*keys, "i", "x", "y", "z")
    return new.unionByName(close)


def limit_slope(line: DataFrame, columns, k: float, keys=EDGE) -> DataFrame:
    """Largest profile not above each clearance column whose slope along arc ``s`` is <= k.
    Closed form of the forward and backward pass: two running minima."""
    ahead = {f"_f_{c}": ("min", F.col(c) - k * F.col("s")) for c in columns}
    back = {f"_b_{c}": ("min", F.col(c) + k * F.col("s")) for c in columns}
    out = O.running(O.running(line, keys, "i", ahead), keys, "i", back, reverse=True)
    made = {c: F.least(F.col(f"_f_{c}") + k * F.col("s"), F.col(f"_b_{c}") - k * F.col("s")) for c in columns}
    return out.withColumns(made).drop(*ahead, *back)


def max_curvature(line: DataFrame, half_span: float = 0.5, step: float = 0.10, keys=EDGE) -> DataFrame:
    """Largest Menger curvature over arc positions (all vertices and every 0.1 m) of the
    points half a span before, at and after.

    Where all three lie on one segment the curvature is zero, so positions farther than half a
    span from both ends of their segment are not made: the work grows with the vertices, not
    with the length. The points are taken from up to ``SIGHT`` segments before and after;
    only positions that need more of the line meet it in arc buckets."""
    c, keys = F.col, list(keys)
    arc = arc_length(line, keys, planar=True)
    tot = arc.groupBy(*keys).agg(F.max("s").alias("_total"), F.count("*").alias("_n"))
    tot = tot.withColumn("_h", F.least(F.lit(half_span), c("_total") * 0.5))
    last = F.greatest(F.lit(0).cast("long"), F.floor((c("_total") - 2 * c("_h") + 1.0e-9) / F.lit(step)))
    usable = tot.filter((c("_n") >= 3) & (c("_total") > 1.0e-9)).withColumn("_last", last).drop("_n")
    seg = O.with_neighbours(arc.select(*keys, "i", "x", "y", "s"), keys, "i", ["x", "y", "s"], back=SIGHT, ahead=SIGHT + 1)
    seg = seg.filter(c("s_n1").isNotNull()).join(usable, keys)
    low, high = f"s_p{SIGHT}", f"s_n{SIGHT + 1}"
    beyond = F.coalesce(c("s") - c("_h") <= c(low), F.lit(False)) | F.coalesce(c("s_n1") + c("_h") > c(high), F.lit(False))
    three = ((F.greatest(c("_c") - c("_h"), F.lit(0.0)), SIGHT, 0), (c("_c"), 0, 0), (F.least(c("_c") + c("_h"), c("_total")), 0, SIGHT))
    # a generator makes each point once: a column would be computed again at each of its uses
    known = F.explode(F.array(F.struct(*[v.alias(f"{a}{k}") for k, at in enumerate(three) for a, v in zip("xy", _seen(*at))])))
    missing = c("_p.x0").isNull() | c("_p.x1").isNull() | c("_p.x2").isNull()
    near = _curve_positions(seg, step).select(*keys, known.alias("_p")).filter(~missing)
    curve = G.menger_curvature(*[(c(f"_p.x{k}"), c(f"_p.y{k}")) for k in (0, 1, 2)])
    best = near.groupBy(*keys).agg(F.max(curve).alias("_best"))
    # the others: one join samples all three points
    far = _curve_positions(seg.filter(beyond), step).select(*keys, "_c", "_h", known.alias("_p")).filter(missing)
    offs = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    t = far.select(*keys, "_c", "_h").distinct().withColumn("_o", offs).withColumn("t", c("_c") + c("_o") * c("_h"))
    p = sample_at_arc(arc, t.select(*keys, "_c", "_o", "t"), keys)
    pick = lambda o, a: F.max(F.when(c("_o") == o, c(a)))
    tri = p.groupBy(*keys, "_c").agg(*[pick(o, a).alias(f"{a}{o + 1}") for o in (-1, 0, 1) for a in "xy"])
    curve = G.menger_curvature(*[(c(f"x{j}"), c(f"y{j}")) for j in (0, 1, 2)])
    more = tri.groupBy(*keys).agg(F.max(curve).alias("_more"))
    out = tot.select(*keys).join(best, keys, "left").join(more, keys, "left")
    return out.select(*keys, F.coalesce(F.greatest("_best", "_more"), F.lit(0.0)).alias("max_curvature"))


def _curve_positions(seg: DataFrame, step: float) -> DataFrame:
    """Positions ``_c`` of ``max_curvature`` on each segment, its end and every ``step``, not
    farther than half a span from one of its ends."""
    c = F.col
    zero = F.lit(0).cast("long")
    # one step more on either side than needed: the exact test follows
    k = lambda at: F.floor((at - c("_h")) / F.lit(step))
    lo, hi = F.greatest(k(c("s")) - 1, zero), F.least(k(c("s_n1")) + 2, c("_last"))
    mid0, mid1 = k(c("s") + c("_h")) + 2, k(c("s_n1") - c("_h")) - 1
    some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    ks = F.when(mid0 >= mid1, some(lo, hi)).otherwise(F.concat(some(lo, F.least(mid0, hi)), some(F.greatest(mid1, lo), hi)))
    at = F.transform(ks, lambda v: F.least(c("_h") + v * F.lit(step), c("_total") - c("_h")))
    out = seg.withColumn("_c", F.explode(F.concat(at, F.array(c("s_n1")))))
    return out.filter((c("_c") > c("s")) & (c("_c") <= c("s_n1")) & (c("_c") >= c("_h")) & (c("_c") <= c("_total") - c("_h")))


def _seen(t: Column, back: int, ahead: int) -> list[Column]:
    """The point at arc ``t`` on a row's own segment, ``back`` ones before or ``ahead`` after, as
    ``sample_at_arc`` has it; NULL beyond them."""
    c = F.col
    names = [f"_p{k}" for k in range(back, 0, -1)] + [""] + [f"_n{k}" for k in range(1, ahead + 2)]
    out: dict[str, Column] = {}
    for j, (a, b) in enumerate(zip(names, names[1:])):
        s0, s1 = c(f"s{a}"), c(f"s{b}")
        first = c("i") == back - j
        r = F.when(s1 - s0 > 1.0e-12, (t - s0) / (s1 - s0)).otherwise(F.lit(0.0))
        on = (t <= s1) & ((t > s0) | (first & (t <= 0.0)))
        for v in "xy":
            point = c(f"{v}{a}") + (c(f"{v}{b}") - c(f"{v}{a}")) * r
            out[v] = out[v].when(on, point) if v in out else F.when(on, point)
    return [out["x"], out["y"]]


def turn_audit(line: DataFrame, sharp_deg: float = 75.0, cusp_deg: float = 120.0, keys=EDGE) -> DataFrame:
    """Per edge: sharp and cusp vertices, and whether consecutive tangents ever oppose."""
    n = O.with_neighbours(line, keys, "i", ["x", "y"])
    c = F.col
    tx = F.coalesce("x_n1", "x") - F.coalesce("x_p1", "x")
    ty = F.coalesce("y_n1", "y") - F.coalesce("y_p1", "y")
    turn = F.coalesce(V.turn_angle(c("x_p1"), c("y_p1"), c("x"), c("y"), c("x_n1"), c("y_n1")), F.lit(0.0))
    n = n.withColumns({"_tx": tx, "_ty": ty, "_turn": turn}).select(*keys, "i", "_tx", "_ty", "_turn")
    m = O.with_neighbours(n, keys, "i", ["_tx", "_ty"], back=1, ahead=0)
    size = F.sqrt(c("_tx") * c("_tx") + c("_ty") * c("_ty"))
    prev = F.sqrt(c("_tx_p1") * c("_tx_p1") + c("_ty_p1") * c("_ty_p1"))
    opposed = (size < 1e-12) | (prev < 1e-12) | (c("_tx") * c("_tx_p1") + c("_ty") * c("_ty_p1") <= 0)
    return m.groupBy(*keys).agg(
        F.count_if(c("_turn") >= math.radians(sharp_deg)).alias("sharp_turns"),
        F.count_if(c("_turn") >= math.radians(cusp_deg)).alias("cusps"),
        F.coalesce(F.bool_or(opposed & c("_tx_p1").isNotNull()), F.lit(False)).alias("tangent_reversal"),
        F.max("_turn").alias("max_turn"),
    )


def split_route(line: DataFrame, max_length: float, turn_deg: float = 75.0) -> tuple[DataFrame, DataFrame]:
    """Chronological drive to a chain of edges: cut at turns >= ``turn_deg``, then into equal
    parts <= ``max_length``; a cut within 1 mm of an inner vertex moves onto it.

    Returns edges (``run_id, edge_id, from_id, to_id, s0, s1``) and their vertices.  Nodes are
    numbered 1..n+1 along the drive and edges follow.
    """
    run = ["run_id"]
    arc = arc_length(line.select("run_id", "i", "x", "y", "z"), run, planar=True)
    near = O.with_neighbours(arc, run, "i", ["x", "y"], back=1, ahead=1)
    c = F.col
    moved = lambda dx, dy: F.sqrt(dx * dx + dy * dy) > ZERO_ARC
    into = F.struct((c("x") - c("x_p1")).alias("x"), (c("y") - c("y_p1")).alias("y"))
    out = F.struct((c("x_n1") - c("x")).alias("x"), (c("y_n1") - c("y")).alias("y"))
    near = near.withColumns({
        "_into": F.when(moved(c("x") - c("x_p1"), c("y") - c("y_p1")), into),
        "_out": F.when(moved(c("x_n1") - c("x"), c("y_n1") - c("y")), out),
        "_end": c("x_n1").isNull(),
    }).drop("x_p1", "y_p1", "x_n1", "y_n1")
    near = O.running(near, run, "i", {"_ti": ("last", c("_into"))})
    near = O.running(near, run, "i", {"_to": ("last", c("_out"))}, reverse=True)
    turn = F.coalesce(V.angle_between(c("_ti.x"), c("_ti.y"), c("_to.x"), c("_to.y")), F.lit(0.0))
    cut = (c("i") > 0) & ~c("_end") & (turn >= math.radians(turn_deg))
    near = cut_lineage(near.withColumn("_cut", cut).drop("_into", "_out", "_ti", "_to"))
    arc = near.select("run_id", "i", "x", "y", "z", "s")
    # span bounds: every break vertex ends one span and starts the next
    marks = near.filter((c("i") == 0) | c("_cut") | c("_end")).select("run_id", "i", "s")
    marks = O.index_rows(marks, run, ["i"], index="k", sized_by=line)
    spans = O.with_neighbours(marks, run, "k", ["i", "s"], back=0, ahead=1).filter(c("s_n1").isNotNull())
    spans = spans.withColumn("_len", c("s_n1") - c("s"))
    limit = max_length - 2.0 * SNAP_M
    parts = F.when(c("_len") > ZERO_ARC, F.greatest(F.lit(1).cast("long"), F.ceil(c("_len") / F.lit(limit)))).otherwise(F.lit(0).cast("long"))
    spans = O.running(spans.withColumn("_parts", parts), run, "k", {"_upto": ("sum", c("_parts"))})
    cuts = spans.filter(c("_parts") > 0).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), c("_parts"))))
    cuts = cuts.select(
        "run_id", "k", "_p", "_parts", c("i").alias("i0"), c("i_n1").alias("i1"), (c("_upto") - c("_parts")).alias("_base"),
        F.when(c("_p") == c("_parts"), c("s_n1")).otherwise(c("s") + c("_len") * c("_p") / c("_parts")).alias("cut_s"),
    )
    snapped = snap_to_vertices(cuts, arc, run)
    snapped = snapped.withColumn("ord", c("_base") + c("_p"))
    start = snapped.filter(c("_p") < c("_parts")).select("run_id", "ord", c("cut_s").alias("s0"))
    stop = snapped.filter(c("_p") > 0).select("run_id", (c("ord") - 1).alias("ord"), c("cut_s").alias("s1"))
    count = spans.groupBy("run_id").agg(F.sum("_parts").alias("_edges"))
    edges = start.join(stop, ["run_id", "ord"]).join(count, "run_id").select(
        "run_id", (c("_edges") + 2 + c("ord")).alias("edge_id"), (c("ord") + 1).alias("from_id"), (c("ord") + 2).alias("to_id"), "s0", "s1"
    )
    edges = cut_lineage(edges)
    points = slice_lines(arc, edges.select("run_id", "edge_id", "s0", "s1"), run, "edge_id", ZERO_ARC)
    return edges, points


def snap_to_vertices(cuts: DataFrame, arc: DataFrame, keys, size: float = 0.5) -> DataFrame:
    """Move ``cut_s`` onto an inner vertex (strictly between positions i0 and i1 of its span)
    that lies within 1 mm. Cuts at span ends are vertices already."""
    v = arc.select(*keys, c_("i", "_vi"), c_("s", "_vs"), F.explode(
        F.array_distinct(F.array(bucket(F.col("s") - SNAP_M, size), bucket(F.col("s") + SNAP_M, size)))
    ).alias("_b"))
    want = cuts.withColumn("_b", bucket(F.col("cut_s"), size))
    near = want.filter((F.col("_p") > 0) & (F.col("_p") < F.col("_parts"))).join(v, [*keys, "_b"])
    gap = F.abs(F.col("_vs") - F.col("cut_s"))
    near = near.filter((F.col("_vi") > F.col("i0")) & (F.col("_vi") < F.col("i1")) & (gap <= SNAP_M))
    best = near.groupBy(*keys, "k", "_p").agg(F.min_by("_vs", F.struct(gap, F.col("_vi"))).alias("_snap"))
    return cuts.join(best, [*keys, "k", "_p"], "left").withColumn("cut_s", F.coalesce("_snap", "cut_s")).drop("_snap")


def c_(name: str, alias: str) -> Column:
    return F.col(name).alias(alias)


def geometry_audit(line: DataFrame, keys=EDGE) -> DataFrame:
    """Per line: lengths, largest height step and grade with the segment that has it, and
    broken segments. ``reason`` is the first failure in segment order."""
    s = segments(line, keys)
    a, b = V.vec(), (F.col("x_n1"), F.col("y_n1"), F.col("z_n1"))
    ok = finite(*a, *b)
    flat = V.dist2(a[0], a[1], b[0], b[1])
    s = s.withColumns({"_ok": ok, "_dz": F.when(ok, F.abs(b[2] - a[2])), "_flat": F.when(ok, flat)})
    zero = F.col("_ok") & (F.col("_flat") <= 1.0e-12) & (F.col("_dz") > 1.0e-12)
    s = s.withColumn("_grade", F.when(F.col("_flat") > 1.0e-12, F.col("_dz") / F.col("_flat")))
    reason = F.when(~F.col("_ok"), "nonfinite_centerline_segment").when(zero, "z_change_at_zero_horizontal_distance")
    first = F.min_by(reason, F.when(reason.isNotNull(), F.col("i")))
    arg = lambda v: F.max_by(F.col("i"), F.struct(F.col(v), -F.col("i")))
    return s.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.sum("_flat").alias("planar_length"),
        F.sum(F.sqrt(F.col("_flat") * F.col("_flat") + F.col("_dz") * F.col("_dz"))).alias("spatial_length"),
        F.max("_dz").alias("max_dz"), arg("_dz").alias("max_dz_segment"),
        F.max("_grade").alias("max_grade"), F.max_by("i", F.when(F.col("_grade").isNotNull(), F.struct("_grade", -F.col("i")))).alias("max_grade_segment"),
        F.count_if(~F.col("_ok")).alias("nonfinite_segments"), F.count_if(zero).alias("zero_distance_z_changes"),
        first.alias("reason"),
    )


def chain_breaks(edges: DataFrame, points: DataFrame, tolerance: float = 1.0e-9) -> DataFrame:
    """Edges of a chronological chain (ordered by ``edge_id``) whose start is not the end of
    the edge before, by node id or by position."""
    ends = points.groupBy(*EDGE).agg(
        F.min_by(F.struct("x", "y", "z"), "i").alias("a"), F.max_by(F.struct("x", "y", "z"), "i").alias("b")
    )
    e = edges.join(ends, EDGE).select("run_id", "edge_id", "from_id", "to_id", "a", "b")
    e = O.index_rows(e, ["run_id"], ["edge_id"], index="k")
    n = O.with_neighbours(e, ["run_id"], "k", ["to_id", "b"], back=1, ahead=0).filter(F.col("to_id_p1").isNotNull())
    xyz = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.z"))
    bad = (F.col("to_id_p1") != F.col("from_id")) | (V.dist3(xyz("b_p1"), xyz("a")) > tolerance)
    return n.filter(bad).select("run_id", "edge_id", F.lit("chronological_edge_chain_disconnected").alias("code"))


def waypoint_yaw(line: DataFrame, closed: bool = False, keys=EDGE) -> DataFrame:
    """Bearing to the next point; the last point of a loop looks at the first, otherwise it
    repeats the bearing before."""
    n = O.with_neighbours(line, keys, "i", ["x", "y"])
    ends = line.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "i").alias("_a"))
    c = F.col
    n = n.join(ends, list(keys))
    to = lambda ax, ay, bx, by: F.atan2(by - ay, bx - ax)
    yaw = F.when(c("x_n1").isNotNull(), to(c("x"), c("y"), c("x_n1"), c("y_n1")))
    if closed:
        apart = V.dist2(c("x"), c("y"), c("_a.x"), c("_a.y")) > 1.0e-9
        yaw = yaw.when(apart, to(c("x"), c("y"), c("_a.x"), c("_a.y")))
    yaw = yaw.otherwise(F.coalesce(to(c("x_p1"), c("y_p1"), c("x"), c("y")), F.lit(0.0)))
    return n.withColumn("yaw", yaw).drop("_a", "x_p1", "y_p1", "x_n1", "y_n1")


def stable_tangent(line: DataFrame, span: float, keys=EDGE) -> DataFrame:
    """Unit direction from a vertex at least ``span`` of arc behind to one at least ``span``
    ahead (or the ends): immune to jitter between close vertices.

    The wanted vertices are the last with s <= s_i - span and the first with s >= s_i + span;
    they are found in arc buckets, with the line ends as the fallback.
    """
    arc = arc_length(line.select(*keys, "i", "x", "y", "z"), keys, planar=True)
    tot = arc.groupBy(*keys).agg(
        F.max("s").alias("_total"), F.min_by(F.struct("x", "y"), "i").alias("_first"), F.max_by(F.struct("x", "y"), "i").alias("_last")
    )
    n = O.with_neighbours(arc, keys, "i", ["s"], back=1, ahead=1)
    # vertex v serves as "behind" for targets in [s_v, s_v+1) and as "ahead" for (s_v-1, s_v]
    of = arc_buckets(arc, keys, max(span, 0.25)).select(*keys, "_size")
    n = n.join(of, list(keys))
    lo = n.filter(F.col("s_n1").isNotNull() & (F.col("s_n1") > F.col("s"))).select(
        *keys, F.col("s").alias("_from"), F.col("s_n1").alias("_to"), F.col("x").alias("bx"), F.col("y").alias("by"),
        in_buckets("s", "s_n1").alias("_b"),
    )
    hi = n.filter(F.col("s_p1").isNotNull() & (F.col("s") > F.col("s_p1"))).select(
        *keys, F.col("s_p1").alias("_from"), F.col("s").alias("_to"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        in_buckets("s_p1", "s").alias("_b"),
    )
    base = arc.join(tot.join(of, list(keys)), list(keys))
    tb, ta = F.col("s") - span, F.col("s") + span
    at = lambda t: F.floor(t / F.col("_size"))
    b = base.filter(tb >= 0).withColumns({"_t": tb, "_b": at(tb)}).join(lo, [*keys, "_b"])
    b = b.filter((F.col("_t") >= F.col("_from")) & (F.col("_t") < F.col("_to"))).select(*keys, "i", "bx", "by")
    a = base.filter(ta <= F.col("_total")).withColumns({"_t": ta, "_b": at(ta)}).join(hi, [*keys, "_b"])
    a = a.filter((F.col("_t") > F.col("_from")) & (F.col("_t") <= F.col("_to"))).select(*keys, "i", "ax", "ay")
    j = base.join(b, [*keys, "i"], "left").join(a, [*keys, "i"], "left")
    dx = F.coalesce("ax", "_last.x") - F.coalesce("bx", "_first.x")
    dy = F.coalesce("ay", "_last.y") - F.coalesce("by", "_first.y")
    j = j.withColumns({"_dx": dx, "_dy": dy}).withColumn("_n", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    unit = lambda v: F.when(F.col("_n") < 1e-12, 0.0).otherwise(F.col(v) / F.col("_n"))
    return j.select(*keys, "i", unit("_dx").alias("tx"), unit("_dy").alias("ty"))


def fix_excursions(line: DataFrame, keys=EDGE) -> DataFrame:
    """Pull isolated two-point excursions (< 0.5 m, both turns >= 75 degrees) onto the chord
    of their neighbours, by share of length. The replacement is in x, y and z."""
    near = O.with_neighbours(line, keys, "i", ["x", "y", "z"], back=1, ahead=2)
    c = F.col
    xy = lambda k: (c(f"x{k}"), c(f"y{k}"))
    p, a, b, n = xy("_p1"), xy(""), xy("_n1"), xy("_n2")
    l1, l2, l3 = V.dist2(*p, *a), V.dist2(*a, *b), V.dist2(*b, *n)
    ang = lambda u, v, w: V.angle_between(v[0] - u[0], v[1] - u[1], w[0] - v[0], w[1] - v[1])
    ok = (
        (l2 + 1e-12 < EXCURSION_MAX_M) & (l1 > 1e-12) & (l2 > 1e-12) & (l3 > 1e-12)
        & (ang(p, a, b) + 1e-12 >= EXCURSION_MIN_TURN) & (ang(a, b, n) + 1e-12 >= EXCURSION_MIN_TURN)
        & (V.dist2(*p, *n) > 1e-12)
    )
    cand = near.filter(ok).withColumns({"_r1": l1 / (l1 + l2 + l3), "_r2": (l1 + l2) / (l1 + l2 + l3)})
    chosen = cand.join(choose_apart(cand, 2, keys, sized_by=line), [*keys, "i"], "left_semi")
    mix = lambda r, v: c(f"{v}_p1") + (c(f"{v}_n2") - c(f"{v}_p1")) * c(r)
    fix = lambda r, off: chosen.select(*keys, (c("i") + off).alias("i"), *[mix(r, v).alias(f"_{v}") for v in "xyz"])
    out = line.join(fix("_r1", 0).unionByName(fix("_r2", 1)), [*keys, "i"], "left")
    return out.withColumn("moved", c("_x").isNotNull()).withColumns({v: F.coalesce(f"_{v}", v) for v in "xyz"}).drop("_x", "_y", "_z")


def simplify(line: DataFrame, tolerance: float = CHORD_ERROR_M, keys=EDGE, solo_rows: int = 50_000) -> DataFrame:
    """Vertices kept by recursive chord splitting (farthest vertex first).

    Spans longer than ``solo_rows`` are split level by level with an aggregation per span; the
    rest is finished span by span in Arrow batches, so no task sees more than ``solo_rows``.
    """
    tip = F.struct("i", "x", "y")
    ends = line.groupBy(*keys).agg(F.min_by(tip, "i").alias("a"), F.max_by(tip, "i").alias("b"))
    state = line.select(*keys, "i", "x", "y").join(ends, list(keys))
    kept = ends.select(*keys, F.explode(F.array("a.i", "b.i")).alias("i")).distinct()
    state = state.filter((F.col("i") > F.col("a.i")) & (F.col("i") < F.col("b.i")))
    big = line.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while big > solo_rows:
        _, _, _, d = G.project((F.col("a.x"), F.col("a.y")), (F.col("b.x"), F.col("b.y")), (F.col("x"), F.col("y")))
        state = cut_lineage(state)
        span = [*keys, F.col("a.i").alias("_a"), F.col("b.i").alias("_b")]
        best = state.withColumn("_d", d).groupBy(*span).agg(
            F.max_by(tip, F.struct("_d", -F.col("i"))).alias("m"), F.max("_d").alias("_far")
        ).filter(F.col("_far") > tolerance)
        best = cut_lineage(best)
        kept = kept.unionByName(best.select(*keys, F.col("m.i").alias("i")))
        state = state.withColumns({"_a": F.col("a.i"), "_b": F.col("b.i")}).join(best.drop("_far"), [*keys, "_a", "_b"])
        left = F.col("i") < F.col("m.i")
        state = state.filter(F.col("i") != F.col("m.i")).select(
            *keys, "i", "x", "y", F.when(left, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(left, F.col("m")).otherwise(F.col("b")).alias("b")
        )
        big = state.groupBy(*keys, F.col("a.i"), F.col("b.i")).count().agg(F.max("count")).first()[0] or 0

    def solve(pdf):
        import numpy as np

        pdf = pdf.sort_values("i")
        px = np.concatenate([[pdf.ax.iloc[0]], pdf.x.to_numpy(), [pdf.bx.iloc[0]]])
        py = np.concatenate([[pdf.ay.iloc[0]], pdf.y.to_numpy(), [pdf.by.iloc[0]]])
        keep, todo = [], [(0, len(px) - 1)]
        while todo:
            lo, hi = todo.pop()
            if hi <= lo + 1:
                continue
            dx, dy = px[hi] - px[lo], py[hi] - py[lo]
            n2 = dx * dx + dy * dy
            qx, qy = px[lo + 1 : hi] - px[lo], py[lo + 1 : hi] - py[lo]
            r = np.clip((qx * dx + qy * dy) / n2, 0, 1) if n2 > 1e-18 else np.zeros(hi - lo - 1)
            dist = np.hypot(qx - r * dx, qy - r * dy)
            far = int(dist.argmax())
            if dist[far] > tolerance:
                mid = lo + 1 + far
                keep.append(mid - 1)
                todo += [(lo, mid), (mid, hi)]
        return pdf.iloc[sorted(keep)][[*keys, "i"]]

    flat = state.select(
        *keys, "i", "x", "y", F.col("a.i").alias("ai"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")
    )
    schema = ", ".join(f"{k} long" for k in [*keys, "i"])
    rest = flat.groupBy(*keys, "ai").applyInPandas(solve, schema)
    out = line.join(kept.unionByName(rest).distinct(), [*keys, "i"], "left_semi")
    return O.reindex(out, keys, "i")


def regularize_centerline(line: DataFrame, keys=EDGE) -> DataFrame:
    """Simplify to 5 cm chord error, then cut into pieces of at most 0.5 m."""
    return densify(simplify(line, CHORD_ERROR_M, keys), CHORD_PIECE_M, keys, planar=False)


def polygon_area(rings: DataFrame, keys=EDGE) -> DataFrame:
    """Signed area of each ring: shoelace sum around its first vertex."""
    n = O.with_neighbours(rings, keys, "i", ["x", "y"], back=0, ahead=1)
    first = rings.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "i").alias("_o"))
    n = n.join(first, list(keys))
    c = F.col
    ax, ay = c("x") - c("_o.x"), c("y") - c("_o.y")
    bx, by = F.coalesce("x_n1", "_o.x") - c("_o.x"), F.coalesce("y_n1", "_o.y") - c("_o.y")
    return n.groupBy(*keys).agg((F.sum(ax * by - ay * bx) * 0.5).alias("area"))
