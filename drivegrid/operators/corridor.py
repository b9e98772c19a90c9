"""The strip that a body sweeps along a line, as extreme lateral support per station.

A rectangular body is driven along the line in steps of ten centimetres. Every sampled point of
its outline that falls into a station's cross-section pushes the station's left or right offset
outwards. Stations and vertices meet in buckets of arc as long as a station's reach. Poses and
outlines are generated per meeting inside the task and aggregated there; of the poses that stand
on one segment only those are made that can be extreme, so the work does not grow with the
length of the segments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.functions import vec as V
from drivegrid.lib import ordered as O
from drivegrid.operators import polylines as pl
from drivegrid.operators.trajectory import arc_length
from drivegrid.session import cut_lineage

# fixed values: spacing of poses and outline points, span of a pose's direction, guards
SPACING_M = 0.10
POSE_SPAN_M = 0.25
GUARD_M = 0.05
CLOSED_M = 1.0e-9
#: Meetings that are solved at once: a few megabytes an array.
STEP_ROWS = 2_000


def _stations(line: DataFrame, keys) -> DataFrame:
    """Vertices with arc, unit tangent over the neighbours, and facts of their line."""
    c = F.col
    clean = pl.drop_consecutive_duplicates(line.select(*keys, "i", "x", "y", "z"), keys, CLOSED_M)
    arc = O.measured(cut_lineage(arc_length(O.measured(cut_lineage(clean)), keys, planar=True)))
    n = O.with_neighbours(arc, keys, "i", ["x", "y", "s"])
    step = F.coalesce(c("s") - c("s_p1"), F.lit(0.0))
    of = n.groupBy(*keys).agg(
        F.max("i").alias("last"), F.max("s").alias("total"), F.max(step).alias("step"),
        F.min_by(F.struct("x", "y"), "i").alias("_a"), F.max_by(F.struct("x", "y"), "i").alias("_b"),
        F.max(F.when(c("i") == 1, F.struct("x", "y"))).alias("_a1"),
    )
    before = n.join(of.select(*keys, "last"), list(keys)).filter("i = last - 1").select(*keys, F.struct("x", "y").alias("_b1"))
    of = of.join(before, list(keys)).withColumn("closed", (c("last") >= 3) & (V.dist2(c("_a.x"), c("_a.y"), c("_b.x"), c("_b.y")) <= CLOSED_M))
    # on a loop both ends take the direction through the seam
    seam = c("closed") & ((c("i") == 0) | (c("i") == c("last")))
    dx = F.when(seam, c("_a1.x") - c("_b1.x")).otherwise(F.coalesce("x_n1", "x") - F.coalesce("x_p1", "x"))
    dy = F.when(seam, c("_a1.y") - c("_b1.y")).otherwise(F.coalesce("y_n1", "y") - F.coalesce("y_p1", "y"))
    j = n.join(of, list(keys)).withColumns({"_dx": dx, "_dy": dy}).withColumn("_n", F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy")))
    j = j.withColumns({"tx": c("_dx") / c("_n"), "ty": c("_dy") / c("_n"), "capture": F.greatest(F.lit(0.10), 0.5 * c("step") + SPACING_M)})
    return j.filter(c("_n") > 1.0e-12).select(*keys, "i", "x", "y", "z", "s", "tx", "ty", "last", "total", "closed", "capture")


def _pieces(st: DataFrame, keys) -> DataFrame:
    """Stations as what the line is around them: ``q_*`` of the vertex, ``p_*`` of the one before,
    ``n_*`` of the next; ``_n`` poses less one on the line. The poses ``c0`` to ``c1`` lie within
    ``POSE_SPAN_M`` of the vertex and of none before it, ``k0`` to ``k1`` stand on the segment after
    it, in its direction. Each pose of the line is in one range of one piece."""
    c, zero = F.col, F.lit(0).cast("long")
    arc = O.with_bound(st.select(*keys, "i", "x", "y", "z", "s", "total", "closed", "capture"), "i", O.bound_of(st, "i"))
    n = O.with_neighbours(arc, keys, "i", ["x", "y", "s"])
    names = {f"{v}{of}": f"{name}_{v}" for v in "xys" for of, name in (("", "q"), ("_p1", "p"), ("_n1", "n"))}
    n = n.withColumnsRenamed(names).withColumn("_n", F.greatest(F.lit(1).cast("long"), F.ceil(c("total") / F.lit(SPACING_M))))
    n = n.withColumn("_d", c("total") / c("_n"))
    after, until = (lambda s: F.floor((c(s) + POSE_SPAN_M) / c("_d")) + 1), (lambda s: F.ceil((c(s) - POSE_SPAN_M) / c("_d")))
    return n.withColumns({
        "c0": F.greatest(zero, until("q_s"), F.coalesce(after("p_s"), zero)), "c1": F.least("_n", after("q_s") - 1),
        "k0": F.greatest(zero, after("q_s")), "k1": F.least("_n", until("n_s") - 1),
    })


def _directed(p: DataFrame) -> DataFrame:
    """``px, py, ux, uy`` from the three points of a pose."""
    c = F.col
    p = p.withColumns({"_dx": c("x2") - c("x0"), "_dy": c("y2") - c("y0")}).withColumn("_u", F.sqrt(c("_dx") * c("_dx") + c("_dy") * c("_dy")))
    p = p.filter(c("_u") > 1.0e-12).withColumns({"px": c("x1"), "py": c("y1"), "ux": c("_dx") / c("_u"), "uy": c("_dy") / c("_u")})
    return p.drop("_dx", "_dy", "_u")


def _near_vertex() -> Column:
    """The pose ``k`` looks no further than the two segments at its piece's vertex."""
    c, t = F.col, F.col("total") * F.col("k") / F.col("_n")
    back, ahead = t - POSE_SPAN_M >= c("p_s"), t + POSE_SPAN_M <= c("n_s")
    return F.when(c("closed"), F.coalesce(back & ahead, F.lit(False))).otherwise(F.coalesce(back, F.lit(True)) & F.coalesce(ahead, F.lit(True)))


def _wide_poses(st: DataFrame, pieces: DataFrame, keys) -> DataFrame:
    """Poses that look beyond the two segments at their vertex (segments under half a metre, the
    seam of a loop): ``keys.., t, px, py, ux, uy``."""
    c = F.col
    arc = O.with_bound(st.select(*keys, "i", "x", "y", "z", "s"), "i", O.bound_of(st, "i"))
    at = pieces.filter("c0 <= c1").withColumn("k", F.explode(F.sequence("c0", "c1"))).filter(~_near_vertex()).withColumn("at", c("total") * c("k") / c("_n"))
    ask = at.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("t", c("at") + c("o") * POSE_SPAN_M)
    around = F.when(c("t") < 0, c("t") + c("total")).when(c("t") >= c("total"), c("t") - c("total")).otherwise(c("t"))
    ask = ask.withColumn("t", F.when(c("closed"), around).otherwise(c("t")))
    got = pl.sample_at_arc(arc, ask.select(*keys, "k", "at", "o", "t"), keys)
    pick = lambda o, a: F.max(F.when(c("o") == o, c(a)))
    p = got.groupBy(*keys, "k", "at").agg(*[pick(o, a).alias(f"{a}{o + 1}") for o in (-1, 0, 1) for a in "xy"])
    return _directed(p).select(*keys, c("at").alias("t"), "px", "py", "ux", "uy")


def _support(points: list[tuple[float, float]], front: float, rear: float, keys):
    """For ``mapInPandas``: greatest offsets ``_l``, ``_r`` of each meeting of a station and a piece.

    All poses at the vertex are tried. On the segment both coordinates in the station's frame are
    linear in the pose: a point that stays in the cross-section between two poses is extreme at
    one of them. Where a border of the section is within a millionth of a pose, the poses on both
    sides are tried; each one tried is tested exactly."""
    import numpy as np

    ahead, side = np.array(points).T

    def solve(v):
        col = lambda name: v[name].to_numpy(np.float64)[:, None]
        x, y, s, tx, ty, cap, d, n, total, since, until = (col(k) for k in ("x", "y", "s", "tx", "ty", "capture", "_d", "_n", "total", "_from", "_to"))
        closed = v["closed"].to_numpy(bool)[:, None]
        low = np.where(~closed & (col("i") == 0), -np.maximum(cap, rear + GUARD_M), -cap)
        high = np.where(~closed & (col("i") == col("last")), np.maximum(cap, front + GUARD_M), cap)
        p, q, r = ({k: col(f"{of}_{k}") for k in "xys"} for of in "pqn")
        most = [np.full(len(v), -np.inf), np.full(len(v), -np.inf)]

        def tried(t, px, py, ux, uy, a, b, good):
            wide = lambda w: w.reshape(len(v), *[1] * (good.ndim - 1))
            gap = wide(s) - t
            good = good & (gap >= -wide(rear + cap)) & (gap <= wide(front + cap)) & (~wide(closed) | (np.abs(gap) <= 0.5 * wide(total)))
            dx, dy = px + ux * a - uy * b - wide(x), py + uy * a + ux * b - wide(y)
            along, left = dx * wide(tx) + dy * wide(ty), dy * wide(tx) - dx * wide(ty)
            good = good & (along >= wide(low)) & (along <= wide(high))
            for k, value in enumerate((left, -left)):
                most[k] = np.maximum(most[k], np.where(good, value, -np.inf).reshape(len(v), -1).max(1, initial=-np.inf))

        # poses at the vertex that look no further than its two segments
        k = col("c0") + np.arange(max(int((v["c1"] - v["c0"]).max()) + 1, 0))
        t = total * k / n
        back, front_ = (t - POSE_SPAN_M >= p["s"]), (t + POSE_SPAN_M <= r["s"])
        good = (k <= col("c1")) & np.where(closed, back & front_, (back | np.isnan(p["s"])) & (front_ | np.isnan(r["s"])))
        at = []
        for o in (-1, 0, 1):
            w = t + o * POSE_SPAN_M
            w = np.where(closed, w, np.maximum(np.minimum(w, total), 0.0))
            before = ~np.isnan(p["s"]) & ((w <= q["s"]) | np.isnan(r["s"]))
            on = lambda one, two, c: one[c] + (two[c] - one[c]) * ((w - one["s"]) / (two["s"] - one["s"]))
            at.append([np.where(before, on(p, q, c), on(q, r, c)) for c in "xy"])
        ux, uy = at[2][0] - at[0][0], at[2][1] - at[0][1]
        size = np.hypot(ux, uy)
        good &= size > 1.0e-12
        tried(*(w[:, :, None] for w in (t, *at[1], ux / size, uy / size)), ahead, side, good[:, :, None])
        # poses on the segment after it
        length = r["s"] - q["s"]
        size = np.hypot(r["x"] - q["x"], r["y"] - q["y"])
        ux, uy = (r["x"] - q["x"]) / size, (r["y"] - q["y"]) / size
        slope = ux * tx + uy * ty
        base = (q["x"] + ux * ahead - uy * side - x) * tx + (q["y"] + uy * ahead + ux * side - y) * ty - slope * q["s"]
        one, two = (low - base) / slope, (high - base) / slope
        level = np.abs(slope) * length < 1.0e-9
        since = np.where(level, since, np.maximum(since, np.minimum(one, two))) / d
        until = np.where(level, until, np.minimum(until, np.maximum(one, two))) / d
        e = 1.0e-6
        k = np.stack([np.ceil(since - e), np.ceil(since + e), np.floor(until - e), np.floor(until + e)], 2)
        k = np.clip(k, col("k0")[:, :, None], col("k1")[:, :, None])
        t = total[:, :, None] * k / n[:, :, None]
        share = (t - q["s"][:, :, None]) / length[:, :, None]
        px, py = (q[c][:, :, None] + (r[c] - q[c])[:, :, None] * share for c in "xy")
        some = ((col("k0") <= col("k1")) & (size > 1.0e-12))[:, :, None] & np.ones(k.shape, dtype=bool)
        tried(t, px, py, ux[:, :, None], uy[:, :, None], ahead[None, :, None], side[None, :, None], some)
        out = v[[*keys, "i"]].assign(_l=most[0], _r=most[1])
        return out[np.isfinite(most[0])]

    def run(batches):
        for pdf in batches:
            with np.errstate(all="ignore"):
                for at in range(0, len(pdf), STEP_ROWS):
                    yield solve(pdf.iloc[at : at + STEP_ROWS])

    return run


def outline(width: float, front: float, rear: float) -> list[tuple[float, float]]:
    """Points (ahead, left) every ``SPACING_M`` or less along the four sides of the body."""
    span, half = front + rear, 0.5 * width
    along, across = (max(1, math.ceil(v / SPACING_M)) for v in (span, width))
    sides = [(-rear + span * k / along, side) for k in range(along + 1) for side in (half, -half)]
    return sides + [(end, -half + width * k / across) for k in range(across + 1) for end in (front, -rear)]


def swept_corridor(line: DataFrame, width: float, front: float, rear: float, margin: float = 0.0, keys=pl.EDGE) -> DataFrame:
    """Per station of the line its offsets and boundary points: ``keys.., i, s, x, y, z,
    left_offset, right_offset, left_x, left_y, right_x, right_y``.

    An offset is the greatest over the station and its two neighbours, plus ``margin`` and a
    guard. Open lines end in caps that hold the whole rear and front overhang; on a closed one
    the body runs through the seam. Repeated vertices are one station. Lines with fewer than
    two stations give no rows."""
    if not (width > 0 and front > 0 and rear > 0 and margin >= 0):
        raise ValueError("body and margin must be positive")
    c, keys = F.col, list(keys)
    st = cut_lineage(_stations(line, keys).filter("total > 0"))
    st = O.measured(st)
    pieces = cut_lineage(_pieces(st, keys))
    reach = lambda ahead: F.lit(ahead) + c("capture")
    # poses from s - front - capture to s + rear + capture, around the seam of a loop; a bucket is as long
    size = reach(front) + reach(rear)
    shift = F.explode(F.when(c("closed"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    spread = st.withColumn("turn", shift).withColumn("s", c("s") + c("turn") * c("total")).filter(
        (c("s") + reach(rear) >= 0) & (c("s") - reach(front) <= c("total"))
    ).withColumns({"_from": c("s") - reach(front), "_to": c("s") + reach(rear)})
    seam = 0.5 * c("total")
    spread = spread.withColumns({"_s0": F.floor(c("_from") / size), "_s1": F.floor(c("_to") / size)}).withColumns({
        "_from": F.when(c("closed"), F.greatest("_from", c("s") - seam)).otherwise(c("_from")),
        "_to": F.when(c("closed"), F.least("_to", c("s") + seam)).otherwise(c("_to")),
    })
    spread = spread.withColumn("_b", F.explode(F.sequence("_s0", "_s1"))).select(*keys, "_b", "_s0", "_from", "_to", "i", "x", "y", "s", "tx", "ty", "last", "total", "closed", "capture")
    around = pieces.withColumns({"_t0": c("q_s") - POSE_SPAN_M, "_t1": F.coalesce("n_s", "q_s") + POSE_SPAN_M})
    around = around.withColumns({"_p0": F.floor(c("_t0") / size), "_p1": F.floor(c("_t1") / size)}).withColumn("_b", F.explode(F.sequence("_p0", "_p1")))
    around = around.select(*keys, "_b", "_p0", "_t0", "_t1", "_n", "_d", "c0", "c1", F.coalesce("k0", F.lit(0).cast("long")).alias("k0"), F.coalesce("k1", F.lit(-1).cast("long")).alias("k1"), *[f"{of}_{v}" for of in "pqn" for v in "xys"])
    points = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in outline(width, front, rear)])
    met = spread.join(around, [*keys, "_b"]).filter((c("_b") == F.greatest("_s0", "_p0")) & (c("_t1") >= c("_from")) & (c("_t0") <= c("_to")))
    near = met.mapInPandas(_support(outline(width, front, rear), front, rear, keys), ", ".join(f"{k} long" for k in [*keys, "i"]) + ", _l double, _r double")
    wide = _wide_poses(st, pieces, keys).join(st.filter("i = 0").select(*keys, size.alias("_size")), keys)
    met = spread.join(wide.withColumn("_b", F.floor(c("t") / c("_size"))).drop("_size"), [*keys, "_b"])
    gap = c("s") - c("t")
    met = met.filter((gap >= -reach(rear)) & (gap <= reach(front)) & (~c("closed") | (F.abs(gap) <= seam))).withColumn("o", F.explode(points))
    dx = c("px") + c("ux") * c("o.a") - c("uy") * c("o.b") - c("x")
    dy = c("py") + c("uy") * c("o.a") + c("ux") * c("o.b") - c("y")
    met = met.withColumns({"_along": dx * c("tx") + dy * c("ty"), "_left": dy * c("tx") - dx * c("ty")})
    head = (c("i") == 0) & (c("_along") <= 0) & (c("_along") >= -(rear + GUARD_M))
    tail = (c("i") == c("last")) & (c("_along") >= 0) & (c("_along") <= front + GUARD_M)
    met = met.filter((~c("closed") & (head | tail)) | (F.abs(c("_along")) <= c("capture")))
    met = near.unionByName(met.select(*keys, "i", c("_left").alias("_l"), (-c("_left")).alias("_r")))
    support = met.groupBy(*keys, "i").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    half = F.lit(0.5 * width)
    wide = st.join(support, [*keys, "i"], "left").withColumns({"_l": F.greatest(half, "_l"), "_r": F.greatest(half, "_r")})
    wide = O.with_neighbours(O.with_bound(wide, "i", O.bound_of(st, "i")), keys, "i", ["_l", "_r"])
    most = lambda v: F.greatest(v, f"{v}_p1", f"{v}_n1") + (margin + GUARD_M)
    out = wide.withColumns({"left_offset": most("_l"), "right_offset": most("_r")})
    cap = F.when(c("closed"), 0.0).when(c("i") == 0, -(rear + GUARD_M)).when(c("i") == c("last"), front + GUARD_M).otherwise(0.0)
    out = out.withColumn("_cap", cap)
    return out.select(
        *keys, "i", "s", "x", "y", "z", "left_offset", "right_offset",
        (c("x") - c("ty") * c("left_offset") + c("tx") * c("_cap")).alias("left_x"), (c("y") + c("tx") * c("left_offset") + c("ty") * c("_cap")).alias("left_y"),
        (c("x") + c("ty") * c("right_offset") + c("tx") * c("_cap")).alias("right_x"), (c("y") - c("tx") * c("right_offset") + c("ty") * c("_cap")).alias("right_y"),
    )


def corridor_rings(corridor: DataFrame, keys=pl.EDGE) -> DataFrame:
    """Open rings ``run_id, ring_id, i, x, y``: left boundary, then the right one backwards."""
    c = F.col
    top = corridor.groupBy(*keys).agg(F.max("i").alias("_top"))
    left = corridor.select(*keys, "i", c("left_x").alias("x"), c("left_y").alias("y"))
    right = corridor.join(top, list(keys)).select(*keys, (2 * c("_top") + 1 - c("i")).alias("i"), c("right_x").alias("x"), c("right_y").alias("y"))
    return left.unionByName(right).withColumnRenamed(keys[-1], "ring_id")
