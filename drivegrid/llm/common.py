"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps column pruning and compression, and
    freezes layouts that a recomputation could change. Survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, near the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_totals(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over the whole table in ``order``, in two levels.

    The rows are range-partitioned and frozen; each range is summed on its own and shifted by
    the totals of the ranges before it (one row per range). A range never holds more than the
    rows between two sampled bounds, so no task sees the whole table."""
    ranged = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_range").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumns({n: F.sum(e).over(inner) for n, e in sums.items()})
        .join(shifts, "_range")
        .withColumns({n: (F.col(n) + F.col(f"_b_{n}")).cast("long") for n in sums})
        .drop("_range", *[f"_b_{n}" for n in sums])
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (smallest node reachable) of undirected links; a node that is its
    own component may be missing.

    Every node first takes its smallest neighbour. What that leaves open, links between the
    chosen ones, is a much smaller graph; it is closed by alternating large-star and small-star
    steps. All tables are written, so Spark knows their sizes and broadcasts small ones."""
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    e = written(ends.distinct())
    first = written(e.groupBy("u").agg(F.min("v").alias("p")))
    other = e.join(first, "u").filter("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"))
    onward = first.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.col("p").alias("v"))
    rest = written(other.unionByName(onward).distinct())
    if rest.isEmpty():
        return first.select(F.col("u").alias("node"), F.col("p").alias("component"))
    stars = _stars(rest)
    top = first.join(stars, F.col("p") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("component", "p").alias("component"))
    return top.unionByName(stars.join(first, F.col("node") == F.col("u"), "left_anti"))


def _stars(e: DataFrame) -> DataFrame:
    """Close a graph of ``u > v`` rows to one star a component: rows ``node, component``."""
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(moved.distinct())
        # done when every node has one parent that has none itself
        twice = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        inner = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if twice.unionByName(inner).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
