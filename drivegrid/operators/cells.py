"""Points, voxels and the cell map.

Cells are sparse rows ``run_id, cx, cy``; ``grid`` is one row per run (``origin_x, origin_y,
width, height`` at a resolution).  Aggregations are partial hash aggregations on cell keys;
neighbourhoods are generated offsets followed by an equi-join or an aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.functions import geom2d as G
from drivegrid.functions import vec as V
from drivegrid.functions.num import finite, lit, saturating_count
from drivegrid.lib import ordered as O
from drivegrid.lib.buckets import broadcast_if_small, spread_offsets

CELL = ["run_id", "cx", "cy"]
YAW_BINS = 72  # fixed value: orientation bins of the body stencil


# --- points -------------------------------------------------------------------------------


def filter_points(points: DataFrame, z_range=(-10.0, 10.0), sensor_range=None) -> DataFrame:
    """Finite points inside the height band and, for sensor-frame clouds, the range ring."""
    x, y, z = V.vec()
    keep = (z >= z_range[0]) & (z <= z_range[1]) & finite(x, y, z, F.col("intensity"))
    if sensor_range is not None:
        r = V.norm((x, y, z))
        keep = keep & (r >= sensor_range[0]) & (r <= sensor_range[1])
    return points.filter(keep)


def every_nth(df: DataFrame, n: int, index: str) -> DataFrame:
    """Stride on a stored index (point in cloud, cloud in run)."""
    return df.filter(F.pmod(F.col(index), F.lit(n)) == 0)


def preview_sample(points: DataFrame, n: int, index: str) -> DataFrame:
    """An even stride of at most ``n`` rows per run over the stored index."""
    sizes = points.groupBy("run_id").agg(F.count("*").alias("_rows"))
    out = points.join(broadcast_if_small(sizes), "run_id")
    stride = F.ceil(F.col("_rows") / F.lit(float(n)))
    return out.filter(F.pmod(F.col(index), stride) == 0).drop("_rows")


def voxelize(points: DataFrame, size: float, min_observations: int = 1) -> DataFrame:
    """Mean position and intensity per voxel; an observation is one scan that hit it.

    The first level counts per (voxel, scan), so the number of scans is a row count and a
    voxel that holds a third of all points is still reduced map-side.
    """
    x, y, z = V.vec()
    good = points.filter(finite(x, y, z, F.col("intensity")))
    keyed = good.withColumns({f"v{a}": G.cell_of(F.col(a), 0.0, size) for a in "xyz"})
    key = ["run_id", "vx", "vy", "vz"]
    sums = {a: F.sum(F.col(a).cast("double")).alias(f"s_{a}") for a in ("x", "y", "z", "intensity")}
    per_scan = keyed.groupBy(*key, "scan_id").agg(*sums.values(), F.count("*").alias("n"))
    total = per_scan.groupBy(*key).agg(
        *[F.sum(f"s_{a}").alias(f"s_{a}") for a in sums], F.sum("n").alias("n"), F.count("*").alias("scans")
    )
    return total.filter(F.col("scans") >= min_observations).select(
        *key,
        *[(F.col(f"s_{a}") / F.col("n")).cast("float").alias(a) for a in sums],
        F.col("n").alias("point_count"),
        saturating_count(F.col("scans")).alias("observation_count"),
    )


def revoxelize(points: DataFrame, size: float) -> DataFrame:
    """The same over already aggregated points: the best observation count (at least 1) wins."""
    x, y, z = V.vec()
    keyed = points.filter(finite(x, y, z, F.col("intensity"))).withColumns(
        {f"v{a}": G.cell_of(F.col(a), 0.0, size) for a in "xyz"}
    )
    return keyed.groupBy("run_id", "vx", "vy", "vz").agg(
        *[F.avg(F.col(a).cast("double")).cast("float").alias(a) for a in ("x", "y", "z", "intensity")],
        F.count("*").alias("point_count"),
        F.max(F.greatest(F.lit(1), F.col("observation_count"))).cast("long").alias("observation_count"),
    )


# --- grid ---------------------------------------------------------------------------------


def grid_extent(poses: DataFrame, crop: float, resolution: float, max_cells: int = 50_000_000) -> DataFrame:
    """Origin and size of each run's grid; a size over the limit is a flag, not an error,
    because cells are stored sparsely."""
    box = poses.groupBy("run_id").agg(
        (F.min("x") - crop).alias("origin_x"), (F.min("y") - crop).alias("origin_y"),
        (F.max("x") + crop).alias("_x1"), (F.max("y") + crop).alias("_y1"),
    )
    side = lambda a, b: F.ceil((F.col(a) - F.col(b)) / F.lit(resolution)) + 1
    return box.select(
        "run_id", "origin_x", "origin_y", side("_x1", "origin_x").alias("width"), side("_y1", "origin_y").alias("height")
    ).withColumn("over_limit", F.col("width") * F.col("height") > max_cells)


def with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(grid.select("run_id", "origin_x", "origin_y", "width", "height")), "run_id")


def inside() -> Column:
    return (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") < F.col("height"))


def to_cells(df: DataFrame, resolution: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns(
        {"cx": G.cell_of(F.col(x), F.col("origin_x"), resolution), "cy": G.cell_of(F.col(y), F.col("origin_y"), resolution)}
    )


def nearest_pose_per_cell(poses: DataFrame, grid: DataFrame, radius: float, resolution: float) -> DataFrame:
    """The nearest pose (earliest on ties) of every cell whose centre is within ``radius`` of
    one.  ``grid`` has the same resolution.  Every batch of poses keeps one row per cell, so the
    cells around the poses are neither sorted nor shuffled as rows."""
    work = to_cells(with_grid(poses.select("run_id", "i", "x", "y", "z", "qx", "qy", "qz", "qw"), grid), resolution)
    work = work.withColumn("yaw", V.q_yaw(V.quat())).select(*CELL, "i", "x", "y", "z", "yaw", "origin_x", "origin_y", "width", "height")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.schema if f.name not in ("origin_x", "origin_y", "width", "height"))
    near = work.mapInPandas(_nearest_of_batch(radius, resolution), schema + ", d2 double")
    best = F.min_by(F.struct("i", "x", "y", "z", "yaw", "d2"), F.struct("d2", "i"))
    return near.groupBy(*CELL).agg(best.alias("p")).select(
        *CELL, F.col("p.i").alias("pose_i"), F.col("p.x").alias("pose_x"), F.col("p.y").alias("pose_y"),
        F.col("p.z").alias("pose_z"), F.col("p.yaw").alias("pose_yaw"), F.col("p.d2").alias("d2"),
    )


def _nearest_of_batch(radius: float, resolution: float):
    reach = int(math.ceil(radius / resolution))

    def first_of(np, run, cx, cy, d2, i):
        """Positions of the smallest (d2, i) of every cell."""
        order = np.lexsort((i, d2, cy, cx, run))
        run, cx, cy = run[order], cx[order], cy[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])
        return order[new]

    def nearest(batches):
        import numpy as np

        for pdf in batches:
            if pdf.empty:
                continue
            a = {c: pdf[c].to_numpy() for c in ("cx", "cy", "i", "x", "y", "origin_x", "origin_y", "width", "height")}
            run = pdf["run_id"].factorize()[0]
            rows, cxs, cys, d2s = [], [], [], []
            for dx in range(-reach, reach + 1):
                for dy in range(-reach, reach + 1):
                    cx, cy = a["cx"] + dx, a["cy"] + dy
                    ex = a["origin_x"] + (cx + 0.5) * resolution - a["x"]
                    ey = a["origin_y"] + (cy + 0.5) * resolution - a["y"]
                    d2 = ex * ex + ey * ey
                    at = np.flatnonzero((cx >= 0) & (cy >= 0) & (cx < a["width"]) & (cy < a["height"]) & (d2 <= radius * radius))
                    # one row per cell and offset before the offsets are put together
                    at = at[first_of(np, run[at], cx[at], cy[at], d2[at], a["i"][at])]
                    rows.append(at), cxs.append(cx[at]), cys.append(cy[at]), d2s.append(d2[at])
            rows, cx, cy, d2 = (np.concatenate(v) for v in (rows, cxs, cys, d2s))
            best = first_of(np, run[rows], cx, cy, d2, a["i"][rows])
            out = pdf[["run_id", "cx", "cy", "i", "x", "y", "z", "yaw"]].iloc[rows[best]]
            yield out.assign(cx=cx[best], cy=cy[best], d2=d2[best])

    return nearest


def assign_points(points: DataFrame, nearest: DataFrame, grid: DataFrame, resolution: float, crop: float | None = None) -> DataFrame:
    """Each point with the pose of its cell; ``crop`` also tests the exact distance. One row
    per cell on the right side, so a hot cell never multiplies; AQE splits it by points."""
    work = to_cells(with_grid(points, grid), resolution).filter(inside())
    out = work.join(nearest.select(*CELL, "pose_i", "pose_x", "pose_y", "pose_z"), CELL)
    if crop is not None:
        dx, dy = F.col("x") - F.col("pose_x"), F.col("y") - F.col("pose_y")
        out = out.filter(dx * dx + dy * dy <= crop * crop)
    return out.drop("origin_x", "origin_y", "width", "height", "cx", "cy")


# --- ground -------------------------------------------------------------------------------


def ground_height_per_cell(points: DataFrame, quantile: float, min_points: int, bin_m: float = 1.0e-3) -> DataFrame:
    """Weighted lower quantile of z per cell (``run_id, cx, cy, z, weight``): the smallest z
    whose cumulative weight exceeds floor(q * (W - 1)).

    Exact, in two levels: weights per millimetre bin find the bin with the rank, then only
    that bin's distinct heights are ordered.  No window sees more than the bins of one cell's
    search band, or the distinct heights of one bin.
    """
    q = min(max(quantile, 0.0), 1.0)
    z = F.col("z").cast("double")
    by_z = points.withColumn("_z", z).groupBy(*CELL, "_z").agg(
        F.sum(F.greatest(F.lit(1), F.col("weight"))).alias("_w"), F.count("*").alias("_n")
    ).withColumn("_bin", G.cell_of(F.col("_z"), 0.0, bin_m))
    bins = by_z.groupBy(*CELL, "_bin").agg(F.sum("_w").alias("_bw"), F.sum("_n").alias("_bn"))
    cell = Window.partitionBy(*CELL)
    run_up = cell.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns(
        {"_cum": F.sum("_bw").over(run_up), "_total": F.sum("_bw").over(cell), "_points": F.sum("_bn").over(cell)}
    ).withColumn("_rank", F.floor(F.lit(q) * (F.col("_total") - 1).cast("double")))
    hit = bins.filter(
        (F.col("_points") >= min_points) & (F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_bw") <= F.col("_rank"))
    ).select(*CELL, "_bin", (F.col("_cum") - F.col("_bw")).alias("_before"), "_rank", "_points")
    inner = Window.partitionBy(*CELL).orderBy("_z").rowsBetween(Window.unboundedPreceding, 0)
    heights = by_z.join(hit, [*CELL, "_bin"]).withColumn("_c", F.sum("_w").over(inner) + F.col("_before"))
    return heights.filter(F.col("_c") > F.col("_rank")).groupBy(*CELL).agg(
        F.min("_z").alias("ground_z"), F.max("_points").alias("points")
    )


def fit_local_plane(
    queries: DataFrame, ground: DataFrame, grid: DataFrame, resolution: float, radius: float,
    min_cells: int, max_slope: float, max_residual: float, keys=("run_id", "query_id"),
) -> DataFrame:
    """Ground height at query points (``keys.., x, y``) from a weighted plane through the
    ground cells within ``radius`` (weight 1 / (1 + d2/r2)); too few cells, a singular fit, a
    steep or a rough plane fall back to the height of the point's own cell, else none.

    The few coarse ground cells are copied to their neighbours, not the many queries; the
    normal equations are ten sums per query, solved in closed form.
    """
    keys = list(keys)
    reach = int(math.ceil(radius / resolution))
    q = to_cells(with_grid(queries, grid), resolution).filter(inside())
    q = q.select(*keys, "cx", "cy", F.col("x").alias("_qx"), F.col("y").alias("_qy"))
    g = with_grid(ground.select(*CELL, "ground_z"), grid).withColumns(
        {"_gx": G.cell_center(F.col("cx"), F.col("origin_x"), resolution), "_gy": G.cell_center(F.col("cy"), F.col("origin_y"), resolution)}
    ).select(*CELL, "ground_z", "_gx", "_gy")
    spread = spread_offsets(g, "cx", "cy", reach)
    m = q.join(spread, CELL, "left")
    dx, dy = F.col("_gx") - F.col("_qx"), F.col("_gy") - F.col("_qy")
    m = m.withColumns({"_dx": dx, "_dy": dy}).withColumn("_d2", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    r2 = radius * radius
    w = F.when(F.col("_d2") <= r2, F.lit(1.0) / (F.lit(1.0) + F.col("_d2") / max(r2, 1.0e-9)))
    m = m.withColumn("_w", w)
    W_, X, Y, Z = (F.col(c) for c in ("_w", "_dx", "_dy", "ground_z"))
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    s = m.groupBy(*keys).agg(
        F.count("_w").alias("n"), F.max(F.when(own, Z)).alias("direct"), F.sum(W_).alias("sw"),
        F.sum(W_ * X).alias("sx"), F.sum(W_ * Y).alias("sy"), F.sum(W_ * Z).alias("sz"),
        F.sum(W_ * X * X).alias("sxx"), F.sum(W_ * X * Y).alias("sxy"), F.sum(W_ * Y * Y).alias("syy"),
        F.sum(W_ * X * Z).alias("sxz"), F.sum(W_ * Y * Z).alias("syz"), F.sum(W_ * Z * Z).alias("szz"),
    )
    c = F.col
    over = F.try_divide  # no cells or a singular fit gives NULL, not an error
    mom = lambda m, u, v: c(m) - over(c(u) * c(v), c("sw"))
    s = s.withColumns({
        "cxx": mom("sxx", "sx", "sx"), "cxy": mom("sxy", "sx", "sy"), "cyy": mom("syy", "sy", "sy"),
        "cxz": mom("sxz", "sx", "sz"), "cyz": mom("syz", "sy", "sz"), "czz": mom("szz", "sz", "sz"),
    }).withColumn("det", c("cxx") * c("cyy") - c("cxy") * c("cxy"))
    s = s.withColumns({
        "a": over(c("cxz") * c("cyy") - c("cyz") * c("cxy"), c("det")),
        "b": over(c("cyz") * c("cxx") - c("cxz") * c("cxy"), c("det")),
    }).withColumns({
        "plane": over(c("sz") - c("a") * c("sx") - c("b") * c("sy"), c("sw")),
        "slope": F.sqrt(c("a") * c("a") + c("b") * c("b")),
        "rms": F.sqrt(over(F.greatest(F.lit(0.0), c("czz") - c("a") * c("cxz") - c("b") * c("cyz")), c("sw"))),
    })
    good = (c("n") >= min_cells) & (F.abs(c("det")) >= 1.0e-12) & (c("slope") <= max_slope) & (c("rms") <= max_residual)
    return s.select(*keys, F.when(good, c("plane")).otherwise(c("direct")).alias("ground_z"), F.coalesce(good, F.lit(False)).alias("fitted"))


# --- evidence and classes ------------------------------------------------------------------


def collision_band(min_obstacle, max_obstacle, body_min, body_max) -> tuple[float, float]:
    """Heights that can be hit: obstacle band and body envelope together."""
    low, high = max(min_obstacle, body_min), min(max_obstacle, body_max)
    if not low < high:
        raise ValueError("body envelope and obstacle heights do not overlap")
    return low, high


def height_above_ground(points: DataFrame, local_ground: DataFrame) -> DataFrame:
    """Points (with cx, cy) joined to their cell's ground; ``height`` is NULL where unknown."""
    g = local_ground.filter(F.col("ground_z").isNotNull()).select(*CELL, "ground_z")
    return points.join(g, CELL, "left").withColumn("height", F.col("z").cast("double") - F.col("ground_z"))


def cell_evidence(points: DataFrame, band: tuple[float, float], free_height: float) -> DataFrame:
    """Per cell: returns inside the collision band, returns on the ground, best observation
    count among the former, and returns over unknown ground."""
    h = F.col("height")
    hit = h.between(*band)
    return points.groupBy(*CELL).agg(
        F.count_if(hit).alias("obstacle_points"),
        F.count_if(F.abs(h) <= free_height).alias("ground_points"),
        F.coalesce(F.max(F.when(hit, F.col("observation_count"))), F.lit(0)).cast("long").alias("max_observations"),
        F.count_if(h.isNull()).alias("unknown_points"),
    )


def supported_cells(evidence: DataFrame, min_points: int, radius: int, min_neighbours: int, min_observations: int) -> DataFrame:
    """Cells with collision returns and whether they are supported: enough in the cell or in
    its neighbourhood, and seen often enough. One shuffle: neighbours and self in one sum."""
    hits = evidence.filter(F.col("obstacle_points") > 0)
    spread = spread_offsets(hits.select(*CELL, "obstacle_points", "max_observations"), "cx", "cy", radius)
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    s = spread.groupBy(*CELL).agg(
        F.sum("obstacle_points").alias("neighbour_points"),
        F.max(F.when(own, F.col("obstacle_points"))).alias("obstacle_points"),
        F.max(F.when(own, F.col("max_observations"))).alias("max_observations"),
    ).filter(F.col("obstacle_points").isNotNull())
    near = (F.col("obstacle_points") >= min_points) | (F.col("neighbour_points") >= min_neighbours)
    return s.withColumn("supported", near & (F.col("max_observations") >= min_observations))


def classify_cells(evidence: DataFrame, support: DataFrame, use_ground: bool, min_ground_points: int) -> DataFrame:
    """obstacle > unsupported return (unknown) > ground-supported free > unknown. Cells without
    a row are unknown too."""
    s = support.select(*CELL, "supported")
    out = evidence.join(s, CELL, "left")
    free = F.lit(use_ground) & F.col("supported").isNull() & (F.col("ground_points") >= min_ground_points)
    obstacle = F.coalesce(F.col("supported"), F.lit(False))
    return out.select(
        *CELL, obstacle.alias("obstacle"), (free & ~obstacle).alias("observed_free"), (~obstacle & ~free).alias("unknown"),
        F.coalesce(~F.col("supported"), F.lit(False)).alias("low_support"),
    )


def sweep_poses(poses: DataFrame, resolution: float, body_radius: float) -> DataFrame:
    """Poses refined so that no body point moves more than half a cell between two of them
    (translation and rotation together); the end pose itself is the last one."""
    work = poses.select("run_id", "i", "x", "y", V.q_yaw(V.quat()).alias("yaw"))
    near = O.with_neighbours(work, ["run_id"], "i", ["x", "y", "yaw"], back=0, ahead=1)
    turn = V.normalize_angle(F.col("yaw_n1") - F.col("yaw"))
    near = near.withColumn("_turn", F.coalesce(turn, F.lit(0.0)))
    motion = V.dist2(F.col("x"), F.col("y"), F.col("x_n1"), F.col("y_n1")) + F.abs("_turn") * body_radius
    pieces = F.greatest(F.lit(1).cast("long"), F.ceil(motion / F.lit(0.5 * resolution)))
    near = near.withColumn("_pieces", F.coalesce(pieces, F.lit(1).cast("long")))
    p = near.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    r = F.col("_k") / F.col("_pieces")
    return p.select(
        "run_id", "i", F.col("_k").alias("piece"),
        (F.col("x") + (F.coalesce("x_n1", "x") - F.col("x")) * r).alias("x"),
        (F.col("y") + (F.coalesce("y_n1", "y") - F.col("y")) * r).alias("y"),
        (F.col("yaw") + F.col("_turn") * r).alias("yaw"),
    )


def stamp_rectangle(poses: DataFrame, grid: DataFrame, resolution: float, front: float, rear: float, half_width: float) -> DataFrame:
    """Cells whose centre lies in the body rectangle of any pose (``run_id, x, y, yaw``)."""
    reach = int(math.ceil(math.hypot(max(front, rear), half_width) / resolution)) + 1
    work = to_cells(with_grid(poses, grid), resolution).withColumns({"_c": F.cos("yaw"), "_s": F.sin("yaw")})
    spread = spread_offsets(work, "cx", "cy", reach).filter(inside())
    dx = G.cell_center(F.col("cx"), F.col("origin_x"), resolution) - F.col("x")
    dy = G.cell_center(F.col("cy"), F.col("origin_y"), resolution) - F.col("y")
    lx = F.col("_c") * dx + F.col("_s") * dy
    ly = F.col("_c") * dy - F.col("_s") * dx
    hit = (lx >= -rear) & (lx <= front) & (F.abs(ly) <= half_width)
    return spread.filter(hit).select(*CELL).distinct()


def stamp_disk(poses: DataFrame, grid: DataFrame, resolution: float, radius: float) -> DataFrame:
    reach = int(math.ceil(radius / resolution))
    work = to_cells(with_grid(poses.select("run_id", "x", "y"), grid), resolution).filter(inside())
    spread = spread_offsets(work, "cx", "cy", reach).filter(inside())
    dx = G.cell_center(F.col("cx"), F.col("origin_x"), resolution) - F.col("x")
    dy = G.cell_center(F.col("cy"), F.col("origin_y"), resolution) - F.col("y")
    return spread.filter(dx * dx + dy * dy <= radius * radius + 1.0e-12).select(*CELL).distinct()


def sweep_footprint(poses: DataFrame, grid: DataFrame, resolution: float, model: str, front: float, rear: float, width: float, erosion: float) -> DataFrame:
    """Cells the body itself has driven over: positive evidence of free space."""
    margin = 0.5 * math.sqrt(2.0) * resolution
    if model == "circle":
        swept = sweep_poses(poses, resolution, 0.0)
        return stamp_disk(swept, grid, resolution, 0.5 * width - erosion + margin)
    swept = sweep_poses(poses, resolution, math.hypot(max(front, rear), 0.5 * width))
    return stamp_rectangle(
        swept, grid, resolution, front - erosion + margin, rear - erosion + margin, 0.5 * width - erosion + margin
    )


def apply_sweep(cells: DataFrame, swept: DataFrame) -> DataFrame:
    """Driven cells become free; ``cleared`` marks those that had been obstacles."""
    flag = swept.select(*CELL, F.lit(True).alias("_swept"))
    out = cells.join(flag, CELL, "full_outer")
    s = F.coalesce("_swept", F.lit(False))
    was = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return out.select(
        *CELL, (was("obstacle", False) & ~s).alias("obstacle"), (was("observed_free", False) | s).alias("observed_free"),
        (was("unknown", True) & ~s).alias("unknown"), (was("obstacle", False) & s).alias("cleared"),
        was("low_support", False).alias("low_support"),
    )


def obstacle_points(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """Collision-band points whose cell is still an obstacle after clearing."""
    return candidates.join(cells.filter("obstacle").select(*CELL), CELL, "left_semi")


def inflate(cells: DataFrame, grid: DataFrame, radius: float, resolution: float) -> DataFrame:
    """Obstacle cells grown by a disk, inside the grid."""
    reach = int(math.ceil(radius / resolution))
    near = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double") * (resolution * resolution) <= radius * radius + 1.0e-12
    spread = spread_offsets(cells.select(*CELL), "cx", "cy", max(reach, 0), near)
    return with_grid(spread, grid).filter(inside()).select(*CELL).distinct()


def inflate_oriented(
    obstacles: DataFrame, cell_yaw: DataFrame, grid: DataFrame, resolution: float,
    front: float, rear: float, width: float, clearance: float, bins: int = YAW_BINS,
) -> DataFrame:
    """Cells (``run_id, cx, cy, yaw``: yaw of the nearest pose) where the body, placed at the
    cell in the yaw's bin, touches an obstacle cell or leaves the grid.

    Obstacles are spread to the cells around them, so the work follows the obstacles; the
    body test is a closed form of the bin's angle, no stencil table.
    """
    half_bin = math.pi / bins
    corner = math.hypot(max(front, rear), 0.5 * width)
    margin = 0.5 * math.sqrt(2.0) * resolution + corner * math.sin(half_bin)
    f, r, side = front + clearance + margin, rear + clearance + margin, 0.5 * width + clearance + margin
    reach = int(math.ceil(math.hypot(max(f, r), side) / resolution))
    turn = 2.0 * math.pi
    pos = F.col("yaw") - F.floor(F.col("yaw") / turn) * turn
    bin_ = F.pmod(F.floor(pos * float(bins) / turn + 0.5), F.lit(bins))
    targets = cell_yaw.withColumn("_a", bin_.cast("double") * (turn / bins)).select(
        *CELL, F.cos("_a").alias("_c"), F.sin("_a").alias("_s")
    )

    def body(dx: Column, dy: Column) -> Column:
        wx, wy = dx.cast("double") * resolution, dy.cast("double") * resolution
        bx = F.col("_c") * wx + F.col("_s") * wy
        by = F.col("_c") * wy - F.col("_s") * wx
        return (bx >= -r) & (bx <= f) & (F.abs(by) <= side)

    # an obstacle at target + (dx, dy) reaches the target: spread with the opposite sign
    spread = spread_offsets(obstacles.select(*CELL), "cx", "cy", reach)
    hit = spread.join(targets, CELL).filter(body(-F.col("dx"), -F.col("dy"))).select(*CELL)
    rim = with_grid(targets, grid).filter(
        (F.col("cx") < reach) | (F.col("cy") < reach) | (F.col("cx") >= F.col("width") - reach) | (F.col("cy") >= F.col("height") - reach)
    ).withColumns({"tx": F.col("cx"), "ty": F.col("cy")})
    out = spread_offsets(rim, "cx", "cy", reach).filter(~inside()).filter(body(F.col("dx"), F.col("dy")))
    out = out.select("run_id", F.col("tx").alias("cx"), F.col("ty").alias("cy"))
    return hit.unionByName(out).distinct()


def cell_partition_audit(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """How the whole grid splits into obstacle, free and unknown cells, and where masks
    overlap. Cells without a row count as unknown."""
    o, f, u = F.col("obstacle"), F.col("observed_free"), F.col("unknown")
    both = (o & f) | (o & u) | (f & u)
    a = cells.groupBy("run_id").agg(
        F.count("*").alias("stored"), F.count_if(o).alias("obstacle"), F.count_if(f).alias("free"), F.count_if(u).alias("_u"),
        F.count_if(both).alias("overlapping"), F.count_if(~(o | f | u)).alias("unclassified"),
    )
    counts = ["stored", "obstacle", "free", "_u", "overlapping", "unclassified"]
    return grid.join(a, "run_id", "left").na.fill(0, counts).select(
        "run_id", (F.col("width") * F.col("height")).alias("cells"), "obstacle", "free",
        (F.col("_u") + F.col("width") * F.col("height") - F.col("stored")).alias("unknown"), "overlapping", "unclassified",
    )


# --- images --------------------------------------------------------------------------------


def dense_lattice(grid: DataFrame) -> DataFrame:
    """Every cell of every run's grid. Rows are generated after a repartition by grid row."""
    rows = grid.select("run_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("cy"))
    rows = rows.repartition("run_id", "cy")
    return rows.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("cx"), "cy")


def to_trinary_cells(cells: DataFrame, grid: DataFrame, fail_closed: bool = False) -> DataFrame:
    """0 obstacle > 205 unknown > 254 free, 205 without a row; a closed gate makes all 205."""
    out = dense_lattice(grid).join(cells.select(*CELL, "obstacle", "observed_free", "unknown"), CELL, "left")
    pixel = F.when(F.col("obstacle"), 0).when(F.col("unknown"), 205).when(F.col("observed_free"), 254).otherwise(205)
    if fail_closed:
        pixel = F.lit(205)
    return out.select(*CELL, F.coalesce(pixel, F.lit(205)).cast("int").alias("pixel"))


def to_binary_mask(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """0 where a cell is set, 254 elsewhere."""
    out = dense_lattice(grid).join(cells.select(*CELL, F.lit(True).alias("_set")), CELL, "left")
    return out.select(*CELL, F.when(F.col("_set"), 0).otherwise(254).cast("int").alias("pixel"))


def parse_trinary(pixels: DataFrame, negate: bool, occupied: float, free: float, max_value: int = 255) -> DataFrame:
    """Image rows (``row, col, pixel, height``) to cells: darker than ``occupied`` is an
    obstacle, brighter than ``free`` is free, else unknown. Image rows run downwards."""
    p = F.col("pixel") / F.lit(float(max_value))
    p = p if negate else F.lit(1.0) - p
    o, f = p > occupied, p < free
    return pixels.select(
        "run_id", F.col("col").alias("cx"), (F.col("height") - 1 - F.col("row")).alias("cy"),
        o.alias("obstacle"), (~o & f).alias("observed_free"), (~o & ~f).alias("unknown"),
    )


# --- the whole chain -------------------------------------------------------------------------


def build_cells(
    points: DataFrame, poses: DataFrame, *, resolution=0.10, crop=6.0, ground_resolution=0.50, assign_resolution=0.50,
    ground_search=(-2.0, 0.5), quantile=0.15, min_ground_points=6, plane_radius=1.5, min_plane_cells=3,
    max_slope=0.35, max_residual=0.12, band=(0.08, 2.00), free_height=0.08, min_points=2, support_radius=1,
    min_neighbours=3, min_observations=1, use_ground=True, min_ground_free=1,
) -> DataFrame:
    """Points and ordered poses to classified cells (before any sweep)."""
    coarse = grid_extent(poses, crop, assign_resolution)
    fine = grid_extent(poses, crop, resolution)
    ground_grid = grid_extent(poses, crop, ground_resolution)
    nearest = nearest_pose_per_cell(poses, coarse, crop, assign_resolution)
    assigned = assign_points(points, nearest, coarse, assign_resolution)
    rel = F.col("z") - F.col("pose_z")
    search = assigned.filter(rel.between(*ground_search)).withColumn("weight", F.col("observation_count"))
    cells_z = to_cells(with_grid(search, ground_grid), ground_resolution).filter(inside())
    ground = ground_height_per_cell(cells_z, quantile, min_ground_points)
    dx, dy = F.col("x") - F.col("pose_x"), F.col("y") - F.col("pose_y")
    near = to_cells(with_grid(assigned.filter(dx * dx + dy * dy <= crop * crop), fine), resolution).filter(inside())
    touched = near.select(*CELL, "origin_x", "origin_y").distinct()
    centers = touched.select(
        *CELL, G.cell_center(F.col("cx"), F.col("origin_x"), resolution).alias("x"), G.cell_center(F.col("cy"), F.col("origin_y"), resolution).alias("y")
    ).withColumnsRenamed({"cx": "fx", "cy": "fy"})
    local = fit_local_plane(
        centers, ground, ground_grid, ground_resolution, plane_radius, min_plane_cells, max_slope, max_residual, ("run_id", "fx", "fy")
    ).withColumnsRenamed({"fx": "cx", "fy": "cy"})
    evidence = cell_evidence(height_above_ground(near.drop("origin_x", "origin_y", "width", "height"), local), band, free_height)
    support = supported_cells(evidence, min_points, support_radius, min_neighbours, min_observations)
    return classify_cells(evidence, support, use_ground, min_ground_free)
