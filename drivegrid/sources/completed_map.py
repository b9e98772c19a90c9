"""A finished map and its trajectory as one input: reduced points, body poses and a report.

The counters of the report are observed in the pass that reduces the points, so nothing is
read twice for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from drivegrid.functions import frames
from drivegrid.functions.num import finite
from drivegrid.operators import cells as ce
from drivegrid.operators import trajectory as tr
from drivegrid.session import cut_lineage


@dataclass
class CompletedMap:
    """``voxels`` as of ``cells.voxelize``; ``poses``: body poses in order; ``report``: one row of
    counters and warnings."""

    voxels: DataFrame
    poses: DataFrame
    report: DataFrame


REPORT = (
    "decoded_points long, strided_points long, accepted_points long, map_voxels long, pose_messages long, used_poses long, warnings array<string>"
)


def read_completed_map(
    points: DataFrame, poses: DataFrame, voxel: float, stride: int = 1, min_z: float = -float("inf"), max_z: float = float("inf"),
    base_from_sensor: tuple[float, ...] | None = None, scan_stride: int = 1, min_observations: int = 1,
) -> CompletedMap:
    """``points``: run_id, idx (dense per run), x, y, z, intensity; ``poses``: run_id, stamp_ns,
    x..qw, of the sensor where ``base_from_sensor`` (x, y, z, qx, qy, qz, qw) is given.

    Every ``stride``-th point inside the z limits is kept and voxelised. A finished map has no
    scans and no sensor origins: scan stride, least observations and range limits cannot apply,
    which the report says."""
    if not (voxel > 0 and stride > 0 and min_z < max_z):
        raise ValueError("voxel size, stride or z limits are out of range")
    c = F.col
    seen = Observation("points")
    taken, inside = c("idx") % stride == 0, (c("z") >= min_z) & (c("z") <= max_z)
    watched = points.withColumns({"_taken": taken, "_kept": taken & inside & finite(c("x"), c("y"), c("z"), c("intensity"))}).observe(
        seen, F.count(F.lit(1)).alias("decoded"), F.count_if("_taken").alias("strided"), F.count_if("_kept").alias("accepted")
    )
    # a finished map counts as one scan
    kept = watched.filter("_kept").withColumn("scan_id", F.lit(0).cast("long"))
    voxels = cut_lineage(ce.voxelize(kept, voxel))  # the pass that is observed
    n = seen.get
    ordered = cut_lineage(tr.normalize_trajectory(poses.withColumn("seq", c("seq") if "seq" in poses.columns else F.lit(0).cast("long"))))
    body = ordered
    if base_from_sensor is not None:
        names = frames.names("b_")
        given = ordered.withColumns({k: F.lit(float(v)) for k, v in zip(names, base_from_sensor)})
        given = given.withColumnsRenamed({k: f"p_{k}" for k in frames.PARTS})
        moved = frames.compose(frames.invert(given, "b_", "s_"), "p_", "s_", "o_")
        body = moved.select("run_id", "i", "stamp_ns", *[c(f"o_{k}").alias(k) for k in frames.PARTS])
    m, k, messages = voxels.count(), ordered.count(), poses.count()
    warnings = []
    if n["accepted"] != n["decoded"]:
        warnings.append(f"points_filtered: {n['accepted']} of {n['decoded']} points are accepted")
    if n["accepted"] != m:
        warnings.append(f"points_voxelized: {n['accepted']} points became {m} voxels")
    if scan_stride != 1:
        warnings.append("scan_stride_not_applied: a finished map has no scans")
    if min_observations != 1:
        warnings.append("min_observations_not_applied: a finished map has no observation history")
    warnings.append("range_limits_not_applied: points of a finished map have no sensor origin")
    row = (n["decoded"], n["strided"], n["accepted"], m, messages, k, warnings)
    return CompletedMap(voxels, body, points.sparkSession.createDataFrame([row], REPORT))
