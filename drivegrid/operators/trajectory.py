"""Time-series operators on pose tables.

Poses: ``run_id, seq, stamp_ns, x, y, z, qx, qy, qz, qw`` (+ dense position ``i`` once
``order_poses`` ran).  ``seq`` is the input order.  All windows go through
``drivegrid.lib.ordered``, so a single long run is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.functions import frames
from drivegrid.functions import vec as V
from drivegrid.functions.num import clamp, finite
from drivegrid.lib import ordered as O
from drivegrid.lib.buckets import broadcast_if_small
from drivegrid.session import cut_lineage

RUN = ["run_id"]
NS = 1.0e-9
# sums of its multiples are exact in a double up to 134,000 km
ARC_GRAIN = 2.0**-26

# fixed values: acquisition-quality limits of the jitter test
JITTER_MAX_SPAN_M = 0.50
JITTER_MIN_TURN = math.radians(90.0)
JITTER_MAX_OUTER_CHANGE = math.radians(45.0)
JITTER_MAX_OUTER_AXIS_ERROR = math.radians(30.0)
JITTER_MIN_INNER_AXIS_ERROR = math.radians(45.0)
JITTER_MAX_YAW_CHANGE = math.radians(30.0)
SHARP_TURN = math.radians(90.0)


def drop_invalid_poses(poses: DataFrame) -> DataFrame:
    """Finite translation and rotation, and a rotation that is not (nearly) zero; the
    rotation is returned normalised."""
    q = V.quat()
    ok = finite(*V.vec(), *q) & (V.q_norm2(q) >= 1.0e-15)
    return frames.unit(poses.filter(ok))


def dedupe_poses(poses: DataFrame) -> DataFrame:
    """One pose per (run, stamp): the last input row wins. A partial aggregation, no sort."""
    rest = [c for c in poses.columns if c not in ("run_id", "stamp_ns")]
    best = F.max_by(F.struct(*rest), "seq").alias("_last")
    return poses.groupBy("run_id", "stamp_ns").agg(best).select("run_id", "stamp_ns", "_last.*")


def order_poses(poses: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """Dense position ``i`` by time; equal stamps keep input order."""
    return O.index_rows(poses, RUN, ["stamp_ns", "seq"], sized_by=sized_by)


def normalize_trajectory(poses: DataFrame) -> DataFrame:
    return order_poses(dedupe_poses(drop_invalid_poses(poses)), sized_by=poses)


def _step3() -> Column:
    return V.dist3((F.col("x_p1"), F.col("y_p1"), F.col("z_p1")), V.vec())


def arc_length(seq: DataFrame, keys=RUN, planar: bool = False, index: str = "i", exact: bool = False) -> DataFrame:
    """Cumulative distance ``s`` along each sequence. A plain running sum loses a bit at every
    row; ``exact`` adds multiples of ``ARC_GRAIN`` and the rests apart, rounded once a row."""
    cols = ["x", "y"] if planar else ["x", "y", "z"]
    near = O.with_neighbours(seq, keys, index, cols, back=1, ahead=0)
    step = V.dist2(F.col("x_p1"), F.col("y_p1"), F.col("x"), F.col("y")) if planar else _step3()
    near = near.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    if exact:
        whole = F.floor(F.col("_step") / F.lit(ARC_GRAIN)).cast("double") * F.lit(ARC_GRAIN)
        near = near.withColumn("_whole", whole)
        out = O.running(near, keys, index, {"_whole_s": ("sum", F.col("_whole")), "_rest_s": ("sum", F.col("_step") - F.col("_whole"))})
        out = out.withColumn("s", F.col("_whole_s") + F.col("_rest_s")).drop("_whole", "_whole_s", "_rest_s")
    else:
        out = O.running(near, keys, index, {"s": ("sum", F.col("_step"))})
    return out.drop("_step", *[f"{c}_p1" for c in cols])


def polyline_length(seq: DataFrame, keys=RUN, index: str = "i") -> DataFrame:
    """Planar and spatial length per sequence."""
    near = O.with_neighbours(seq, keys, index, ["x", "y", "z"], back=1, ahead=0)
    flat = V.dist2(F.col("x_p1"), F.col("y_p1"), F.col("x"), F.col("y"))
    return near.groupBy(*keys).agg(
        F.coalesce(F.sum(flat), F.lit(0.0)).alias("length_2d"),
        F.coalesce(F.sum(_step3()), F.lit(0.0)).alias("length_3d"),
        F.count("*").alias("points"),
    )


def split_segments(poses: DataFrame, max_jump: float, max_speed: float) -> DataFrame:
    """Number the continuous stretches: a new one starts where the displacement or the
    speed (infinite at equal stamps) is over its limit."""
    near = O.with_neighbours(poses, RUN, "i", ["x", "y", "z", "stamp_ns"], back=1, ahead=0)
    d = _step3()
    dt = (F.col("stamp_ns") - F.col("stamp_ns_p1")).cast("double") * NS
    speed = F.when(dt > 1.0e-9, d / dt).otherwise(F.lit(float("inf")))
    start = F.coalesce((d > max_jump) | (speed > max_speed), F.lit(False))
    near = near.withColumns({"_d": d, "_start": start})
    near = O.islands(near, RUN, "i", F.col("_start"), "segment")
    step = F.when(F.col("_start"), F.lit(0.0)).otherwise(F.coalesce(F.col("_d"), F.lit(0.0)))
    return near.withColumn("step", step).drop("_d", "_start", "x_p1", "y_p1", "z_p1", "stamp_ns_p1")


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("run_id", "segment").agg(
        F.sum("step").alias("length"),
        F.count("*").alias("poses"),
        F.min("i").alias("first_i"),
        F.max("i").alias("last_i"),
    )


def pick_segment(summary: DataFrame) -> DataFrame:
    """Longest stretch (to the nanometre), then most poses, then earliest."""
    nm = F.floor(F.col("length") * 1.0e9 + 0.5)
    rank = F.struct(nm, F.col("poses"), -F.col("segment"))
    best = F.max_by(F.struct("segment", "length", "poses", "first_i", "last_i"), rank)
    return summary.groupBy("run_id").agg(
        best.alias("b"), (F.count("*") - 1).alias("discarded_segments")
    ).select("run_id", "b.*", "discarded_segments")


def longest_segment(poses: DataFrame, max_jump: float, max_speed: float) -> DataFrame:
    """Only the poses of each run's best stretch, renumbered from zero."""
    segments = split_segments(poses, max_jump, max_speed)
    best = pick_segment(segment_summary(segments)).select("run_id", "segment", "first_i")
    kept = segments.join(best, ["run_id", "segment"])
    return kept.withColumn("i", F.col("i") - F.col("first_i")).drop("first_i", "segment", "step")


def remove_stationary(poses: DataFrame, min_distance: float, chunk_rows: int = 100_000) -> DataFrame:
    """Keep a pose that is at least ``min_distance`` from the last *kept* one; the last pose
    of a run always stays.

    The decision depends on all earlier ones, so it is taken chunk by chunk: each chunk is
    solved for its own start state by a vectorised scan in Arrow, and chunks after the first
    are re-solved with the last kept pose of the chunk before.  A chunk hands over only one
    position, and the hand-over stops changing as soon as both solutions share a kept pose.
    The poses are read in every round: they are written once.
    """
    poses = O.with_bound(cut_lineage(poses), "i", O.bound_of(poses, "i"))
    slim = poses.select("run_id", "i", "x", "y", "z")
    kept = _stationary_keep(slim, min_distance, chunk_rows)
    last = poses.groupBy("run_id").agg(F.max("i").alias("i")).withColumn("_end", F.lit(True))
    flagged = cut_lineage(kept.unionByName(last.select("run_id", "i")).distinct())
    return O.reindex(poses.join(broadcast_if_small(flagged), ["run_id", "i"], "left_semi"), RUN, "i")


def _stationary_keep(slim: DataFrame, min_distance: float, chunk_rows: int) -> DataFrame:
    limit = float(min_distance)

    def scan(key, pdf):
        pdf = pdf.sort_values("i")
        pts = pdf[["x", "y", "z"]].to_numpy()
        seed = pdf[["sx", "sy", "sz"]].to_numpy()[0]
        keep = []
        here = seed
        for n in range(len(pts)):  # a pose-rate scan; a chunk has at most chunk_rows rows
            p = pts[n]
            if here[0] != here[0]:
                far = True
            else:
                dx, dy, dz = p[0] - here[0], p[1] - here[1], p[2] - here[2]
                far = (dx * dx + dy * dy + dz * dz) ** 0.5 >= limit
            if far:
                keep.append(n)
                here = p
        return pdf.iloc[keep][["run_id", "chunk", "i", "x", "y", "z"]]

    nan = F.lit(float("nan"))
    chunks = slim.withColumn("chunk", O.chunk_of("i", chunk_rows))
    every = cut_lineage(chunks.select("run_id", "chunk").distinct())  # one row for chunk_rows poses
    n_chunks = every.agg(F.max("chunk")).first()[0] or 0
    schema = "run_id long, chunk long, i long, x double, y double, z double"
    seeded = chunks.withColumns({"sx": nan, "sy": nan, "sz": nan})
    solved = seeded.groupBy("run_id", "chunk").applyInPandas(scan, schema)
    if n_chunks == 0:
        return solved.select("run_id", "i")
    # Fixpoint over hand-overs: a round re-solves only chunks whose incoming pose changed.
    solved = cut_lineage(solved)
    used = None
    while True:
        ends = solved.groupBy("run_id", "chunk").agg(
            F.max_by(F.struct("i", "x", "y", "z"), "i").alias("e")
        )
        w = Window.partitionBy("run_id").orderBy("chunk")
        all_chunks = every.join(ends, ["run_id", "chunk"], "left")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        seeds = all_chunks.select(
            "run_id", "chunk", F.last("e", ignorenulls=True).over(before).alias("seed")
        ).filter(F.col("seed").isNotNull())
        seeds = cut_lineage(seeds)
        if used is None:
            changed = seeds
        else:
            old = used.select("run_id", "chunk", F.col("seed.i").alias("old_i"))
            changed = seeds.join(old, ["run_id", "chunk"], "left").filter(
                ~F.col("seed.i").eqNullSafe(F.col("old_i"))
            ).drop("old_i")
        if changed.isEmpty():
            return solved.select("run_id", "i")
        todo = chunks.join(F.broadcast(changed), ["run_id", "chunk"]).select(
            *chunks.columns,
            F.col("seed.x").alias("sx"),
            F.col("seed.y").alias("sy"),
            F.col("seed.z").alias("sz"),
        )
        again = todo.groupBy("run_id", "chunk").applyInPandas(scan, schema)
        rest = solved.join(F.broadcast(changed.select("run_id", "chunk")), ["run_id", "chunk"], "left_anti")
        solved = cut_lineage(rest.unionByName(again))
        used = seeds


def resample(poses: DataFrame, interval: float) -> DataFrame:
    """Poses every ``interval`` metres of arc, interpolated in time, place and rotation; the
    end pose is added when it lies more than 1 micrometre from the last sample."""
    cols = ["stamp_ns", "x", "y", "z", "qx", "qy", "qz", "qw"]
    line = arc_length(poses, exact=True)
    seg = O.with_neighbours(line, RUN, "i", [*cols, "s"], back=0, ahead=1)
    seg = seg.join(_totals(line), "run_id")
    step = F.lit(float(interval))
    first = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.floor(F.col("s") / step) + 1)
    last = F.floor(F.col("s_n1") / step)
    long_run = F.col("total") >= interval
    inside = seg.filter(F.col("s_n1").isNotNull() & long_run & (first <= last))
    k = inside.withColumn("k", F.explode(F.sequence(first, last)))
    k = k.withColumn("target", F.col("k").cast("double") * step).filter(
        F.col("target") < F.col("total")
    )
    span = F.col("s_n1") - F.col("s")
    ratio = F.when(span > 1.0e-12, (F.col("target") - F.col("s")) / span).otherwise(F.lit(0.0))
    k = k.withColumn("_r", clamp(ratio, 0.0, 1.0))
    after = [*frames.PARTS, "stamp_ns"]
    k = k.withColumnsRenamed({f"{c}_n1": f"b_{c}" for c in after})
    k = frames.interpolate(k, "", "b_", F.col("_r"), "o_")
    dt = (F.col("b_stamp_ns") - F.col("stamp_ns")).cast("double")
    samples = k.select(
        "run_id",
        F.col("k").alias("i"),
        (F.col("stamp_ns") + F.floor(F.col("_r") * dt + 0.5)).alias("stamp_ns"),
        *[F.col(f"o_{n}").alias(n) for n in frames.PARTS],
        F.col("target").alias("s"),
    )
    ends = _run_ends(line, cols, interval)
    tail = samples.groupBy("run_id").agg(F.max_by(F.struct("i", "x", "y", "z"), "i").alias("t"))
    extra = ends.join(tail, "run_id", "left")
    gap = V.dist3((F.col("t.x"), F.col("t.y"), F.col("t.z")), V.vec())
    extra = extra.filter(F.col("is_first") | F.col("t").isNull() | (gap > 1.0e-6)).select(
        "run_id",
        F.when(F.col("is_first"), F.lit(0).cast("long"))
        .otherwise(F.coalesce(F.col("t.i"), F.lit(0).cast("long")) + 1)
        .alias("i"),
        *cols,
        "s",
    )
    return samples.unionByName(extra)


def _totals(line: DataFrame) -> DataFrame:
    return line.groupBy("run_id").agg(F.max("s").alias("total"))


def _run_ends(line: DataFrame, cols, interval: float) -> DataFrame:
    """The last pose of each run, and the first pose too when the run is shorter than one
    interval (such a run is returned as its two end poses)."""
    pose = F.struct("i", *cols, "s")
    ends = line.groupBy("run_id").agg(
        F.min_by(pose, "i").alias("a"), F.max_by(pose, "i").alias("b"), F.max("s").alias("total")
    )
    first = ends.filter((F.col("total") < interval) & (F.col("b.i") > 0))
    return first.select("run_id", "a.*", F.lit(True).alias("is_first")).unionByName(
        ends.select("run_id", "b.*", F.lit(False).alias("is_first"))
    ).drop("i")


def jitter_candidates(poses: DataFrame) -> DataFrame:
    """Poses that start a two-sample lateral excursion, with the corrected positions of the
    pose and its successor (x_fix, y_fix, x_fix2, y_fix2)."""
    work = poses.withColumn("yaw", V.q_yaw(V.quat()))
    work = work.withColumns({"bx": F.cos("yaw"), "by": F.sin("yaw")})
    near = O.with_neighbours(work, RUN, "i", ["x", "y", "stamp_ns", "yaw", "bx", "by"], back=1, ahead=2)
    c = F.col
    p = {k: (c(f"x{k}"), c(f"y{k}")) for k in ("_p1", "", "_n1", "_n2")}
    before, first, second, after = p["_p1"], p[""], p["_n1"], p["_n2"]
    go = lambda a, b: (b[0] - a[0], b[1] - a[1])
    into, across, out = go(before, first), go(first, second), go(second, after)
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    body, body_n = (c("bx"), c("by")), (c("bx_n1"), c("by_n1"))
    ok = (
        (size(into) > 1e-9) & (size(across) > 1e-9) & (size(out) > 1e-9)
        & (size(across) <= JITTER_MAX_SPAN_M)
        & (V.angle_between(*into, *across) + 1e-12 >= JITTER_MIN_TURN)
        & (V.angle_between(*across, *out) + 1e-12 >= JITTER_MIN_TURN)
        & (V.angle_between(*into, *out) <= JITTER_MAX_OUTER_CHANGE)
        & (V.axis_angle(*into, *body) <= JITTER_MAX_OUTER_AXIS_ERROR)
        & (V.axis_angle(*out, *body_n) <= JITTER_MAX_OUTER_AXIS_ERROR)
        & (V.axis_angle(*across, *body) > JITTER_MIN_INNER_AXIS_ERROR)
        & (V.axis_angle(*across, *body_n) > JITTER_MIN_INNER_AXIS_ERROR)
        & (V.angle_between(*body, *body_n) <= JITTER_MAX_YAW_CHANGE)
    )
    span = (c("stamp_ns_n2") - c("stamp_ns_p1")).cast("double")

    def fixed(stamp, fallback):
        r = F.when(
            span > 0, clamp((stamp - c("stamp_ns_p1")).cast("double") / span, 0.0, 1.0)
        ).otherwise(F.lit(fallback))
        return tuple(a + r * (b - a) for a, b in zip(before, after))

    fx, fy = fixed(c("stamp_ns"), 1.0 / 3.0)
    gx, gy = fixed(c("stamp_ns_n1"), 2.0 / 3.0)
    return near.filter(ok).select(
        "run_id", "i", fx.alias("x_fix"), fy.alias("y_fix"), gx.alias("x_fix2"), gy.alias("y_fix2")
    )


def choose_apart(cands: DataFrame, apart: int, keys=RUN, index: str = "i", sized_by: DataFrame | None = None, solo_rows: int = 10_000) -> DataFrame:
    """Greedy left-to-right choice of positions at least ``apart`` from the last chosen one.

    Candidates further apart than that never influence each other, so each cluster of close
    ones is solved alone, by one ``aggregate`` over its short array.  If a cluster is longer
    than ``solo_rows``, the choice is followed by pointer doubling instead: every candidate
    points to the first one far enough ahead, and what the cluster heads reach is chosen.
    """
    dense = O.index_rows(cands.select(*keys, index), keys, [index], index="_n", sized_by=sized_by)
    near = O.with_neighbours(dense, keys, "_n", [index], back=1, ahead=apart)
    gap = F.coalesce(F.col(index) - F.col(f"{index}_p1"), F.lit(apart).cast("long"))
    ahead = [F.col(f"{index}_n{k}") for k in range(1, apart + 1)]
    nxt = F.coalesce(*[F.when(v >= F.col(index) + apart, v) for v in ahead])
    near = cut_lineage(near.withColumns({"_head": gap >= apart, "_next": nxt}).select(*keys, index, "_n", "_head", "_next"))
    near = O.with_bound(near, "_n", O.bound_of(dense, "_n"))
    grouped = O.islands(near, keys, "_n", F.col("_head"), "_cluster")
    longest = grouped.groupBy(*keys, "_cluster").count().agg(F.max("count")).first()[0] or 0
    if longest <= solo_rows:
        lists = grouped.groupBy(*keys, "_cluster").agg(F.array_sort(F.collect_list(index)).alias("c"))
        chosen = F.aggregate(
            F.col("c"),
            F.array().cast("array<bigint>"),
            lambda acc, v: F.when(
                (F.size(acc) == 0) | (v - F.try_element_at(acc, F.lit(-1)) >= apart),
                F.concat(acc, F.array(v)),
            ).otherwise(acc),
        )
        return lists.select(*keys, F.explode(chosen).alias(index))
    reached = cut_lineage(near.filter("_head").select(*keys, index))
    jump = near.filter(F.col("_next").isNotNull()).select(*keys, index, "_next")
    for _ in range(max(1, math.ceil(math.log2(longest)) + 1)):
        jump = cut_lineage(jump)
        step = reached.join(jump, [*keys, index]).select(*keys, F.col("_next").alias(index))
        reached = cut_lineage(reached.unionByName(step).distinct())
        far = jump.select(*keys, F.col(index).alias("_next"), F.col("_next").alias("_n2"))
        jump = jump.join(far, [*keys, "_next"]).select(*keys, index, F.col("_n2").alias("_next"))
    return reached


def fix_position_jitter(poses: DataFrame) -> DataFrame:
    """Replace the planar position of isolated two-sample excursions; adds ``corrected`` and
    ``correction_m``. A chosen excursion covers two poses and blocks its two neighbours."""
    cands = jitter_candidates(poses)
    chosen = cands.join(choose_apart(cands, 3, sized_by=poses), [*RUN, "i"], "left_semi")
    fixes = chosen.select("run_id", "i", F.col("x_fix").alias("_fx"), F.col("y_fix").alias("_fy")).unionByName(
        chosen.select("run_id", (F.col("i") + 1).alias("i"), F.col("x_fix2").alias("_fx"), F.col("y_fix2").alias("_fy"))
    )
    out = poses.join(fixes, ["run_id", "i"], "left")
    hit = F.col("_fx").isNotNull()
    moved = V.dist2(F.col("x"), F.col("y"), F.col("_fx"), F.col("_fy"))
    return out.withColumns(
        {
            "corrected": hit,
            "correction_m": F.when(hit, moved).otherwise(F.lit(0.0)),
            "x": F.coalesce("_fx", "x"),
            "y": F.coalesce("_fy", "y"),
        }
    ).drop("_fx", "_fy")


def jitter_audit(before: DataFrame, fixed: DataFrame) -> DataFrame:
    lengths = polyline_length(before).select("run_id", F.col("length_2d").alias("length_before"))
    after = polyline_length(fixed).select("run_id", F.col("length_2d").alias("length_after"))
    stats = fixed.groupBy("run_id").agg(
        F.count_if("corrected").alias("corrected_poses"),
        F.max("correction_m").alias("max_correction"),
    )
    return lengths.join(after, "run_id").join(stats, "run_id").withColumn(
        "corrected_runs", F.expr("corrected_poses div 2")
    )


def mark_sharp_turns(seq: DataFrame, keys=RUN, angle: float = SHARP_TURN, index="i") -> DataFrame:
    near = O.with_neighbours(seq, keys, index, ["x", "y"])
    c = F.col
    turn = V.turn_angle(c("x_p1"), c("y_p1"), c("x"), c("y"), c("x_n1"), c("y_n1"))
    return near.withColumn("sharp", F.coalesce(turn >= angle, F.lit(False))).drop(
        "x_p1", "y_p1", "x_n1", "y_n1"
    )


def smooth_positions(poses: DataFrame, window: float, interval: float) -> DataFrame:
    """Moving mean over +-r samples, clipped at the nearest sharp turn on either side; turn
    samples and run ends stay where they are."""
    r = max(1, int(math.floor(window / (2.0 * interval) + 0.5)))
    if window <= 0:
        return poses
    sizes = poses.groupBy("run_id").agg(F.count("*").alias("_n"))
    work = mark_sharp_turns(poses).join(sizes, "run_id")
    work = work.withColumn("_r", F.least(F.lit(r).cast("long"), F.expr("(_n - 1) div 2")))
    turn_i = F.when(F.col("sharp"), F.col("i"))

    def frames(w):
        return {
            "_lt": F.max(turn_i).over(w.rowsBetween(-r, -1)),
            "_nt": F.min(turn_i).over(w.rowsBetween(1, r)),
            "_pts": F.collect_list(F.struct("i", "x", "y", "z")).over(w.rowsBetween(-r, r)),
        }

    out = O.over_frame(work, RUN, "i", frames, r, r)
    c = F.col
    lo = F.greatest(c("i") - c("_r"), F.coalesce(c("_lt"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    hi = F.least(c("i") + c("_r"), c("_n") - 1, F.coalesce(c("_nt"), c("_n")))
    out = out.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "_in", F.filter("_pts", lambda p: (p.i >= c("_lo")) & (p.i <= c("_hi")))
    )
    fixed = c("sharp") | (c("i") == 0) | (c("i") == c("_n") - 1) | (c("_n") < 3)

    def mean(axis):
        total = F.aggregate(F.transform("_in", lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v)
        return F.when(fixed, c(axis)).otherwise(total / F.size("_in"))

    return out.withColumns({"x": mean("x"), "y": mean("y"), "z": mean("z")}).drop(
        "_n", "_r", "_lt", "_nt", "_pts", "_lo", "_hi", "_in"
    )


def process_trajectory(
    poses: DataFrame,
    max_jump: float = 2.0,
    max_speed: float = 20.0,
    min_translation: float = 0.03,
    interval: float = 0.20,
    smoothing_window: float = 0.0,
) -> DataFrame:
    """Raw poses to the clean trajectory, in the fixed order of the cleaning steps."""
    line = longest_segment(normalize_trajectory(poses), max_jump, max_speed)
    line = remove_stationary(line, min_translation)
    line = fix_position_jitter(resample(line, interval))
    return smooth_positions(line, smoothing_window, interval) if smoothing_window > 0 else line


def yaw_range(poses: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Range of the unwrapped yaw from position ``from_i`` of each run (default 0) onward."""
    work = poses.select("run_id", "i", V.q_yaw(V.quat()).alias("yaw"))
    near = O.with_neighbours(work, RUN, "i", ["yaw"], back=1, ahead=0)
    step = F.coalesce(V.normalize_angle(F.col("yaw") - F.col("yaw_p1")), F.col("yaw"))
    path = O.running(near, RUN, "i", {"u": ("sum", step)})
    if start is not None:
        path = path.join(start, "run_id").filter(F.col("i") >= F.col("from_i"))
    return path.groupBy("run_id").agg((F.max("u") - F.min("u")).alias("yaw_range"))
