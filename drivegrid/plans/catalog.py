"""All queries in one place, and the flagship question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivegrid.operators import cells as ce
from drivegrid.operators import trajectory as tr
from drivegrid.plans import (  # noqa: F401
    authoring_queries,
    cell_queries,
    function_queries,
    graph_queries,
    interval_queries,
    polyline_queries,
    quality_queries,
    registration_queries,
    release_queries,
    source_queries,
    spatial_queries,
    stream_queries,
    topology_queries,
    trajectory_queries,
)
from drivegrid.plans.registry import CHECKS, QUERIES, query
from drivegrid.plans.tables import view, with_views
from drivegrid.plans.trajectory_queries import LINE, q

__all__ = ["CHECKS", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per drive: length, voxels, cells with returns in the collision band, obstacle cells."""
    line = tr.normalize_trajectory(view(spark, sf_dir, "poses_v"))
    length = tr.polyline_length(line).select("run_id", "length_2d")
    voxels = ce.voxelize(view(spark, sf_dir, "points_v"), 0.25)
    band = F.col("z").between(0.08, 2.0)
    cells = voxels.groupBy("run_id", F.expr("floor(vx / 2)").alias("cx"), F.expr("floor(vy / 2)").alias("cy")).agg(
        F.count("*").alias("voxels"), F.count_if(band).alias("hits")
    )
    per = cells.groupBy("run_id").agg(
        F.sum("voxels").alias("voxels"), F.count("*").alias("cells"), F.count_if(F.col("hits") >= 2).alias("obstacle_cells")
    )
    return length.join(per, "run_id").select("run_id", q("length_2d"), "voxels", "cells", "obstacle_cells")


query(
    "flagship_drive_summary",
    with_views("poses_v", "points_v") + LINE[len(with_views("poses_v")):] + """,
ln AS (SELECT run_id, sum(d) AS l FROM (SELECT run_id, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS d FROM line WINDOW w AS (PARTITION BY run_id ORDER BY i)) GROUP BY 1),
vx AS (SELECT run_id, CAST(floor(x / 25e-2) AS BIGINT) AS a, CAST(floor(y / 25e-2) AS BIGINT) AS b, CAST(floor(z / 25e-2) AS BIGINT) AS c, CAST(avg(z) AS FLOAT) AS z FROM points_v GROUP BY 1, 2, 3, 4),
cl AS (SELECT run_id, floor(a / 2e0) AS cx, floor(b / 2e0) AS cy, count(*) AS v, count(*) FILTER (CAST(z AS DOUBLE) BETWEEN 8e-2 AND 2e0) AS h FROM vx GROUP BY 1, 2, 3)
SELECT c.run_id, floor(any_value(l) * 1e6 + 4.137e-1) / 1e6 AS length_2d, CAST(sum(v) AS BIGINT) AS voxels, count(*) AS cells, count(*) FILTER (h >= 2) AS obstacle_cells FROM cl c JOIN ln USING (run_id) GROUP BY c.run_id""",
)(flagship)
