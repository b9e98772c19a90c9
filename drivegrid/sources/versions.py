"""Publishing sets of tables: versioned folders, an audit, and one appended pointer row.

    <root>/<table>/version=<v>/run_id=<r>/...   rows of the runs that version v wrote
    <root>/_manifest/version=<v>/...            which version every run of every table is read from
    <root>/_published/...                       one row per published version

Nothing that a reader may look at is ever overwritten. The tables of a version are written
first, then the manifest, then the audit reads all of it back, and the last step is one
appended row; a writer that stops anywhere before it leaves the old set in force. One writer
at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version long, tables array<string>"
_ROW = "_row"
_MANIFEST = "table string, run_id long, from_version long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of the store; without rows while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def published_version(spark: SparkSession, root: str) -> int | None:
    return _read(spark, f"{root}/_published", _POINTER).agg(F.max("version")).first()[0]


def _at(spark: SparkSession, root: str, name: str, manifest: DataFrame) -> DataFrame:
    """Rows of ``name``: each run from the version that wrote it last. Spark prunes the folders
    by the manifest's rows."""
    mine = manifest.filter(F.col("table") == name).select("run_id", F.col("from_version").alias("version"))
    data = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    data = data.withColumns({"run_id": F.col("run_id").cast("long"), "version": F.col("version").cast("long")})
    return data.join(F.broadcast(mine) if mine.limit(100_001).count() <= 100_000 else mine, ["run_id", "version"], "left_semi").drop("version", _ROW)


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the published set, or of an earlier one."""
    v = published_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return _at(spark, root, name, _read(spark, f"{root}/_manifest/version={v}", _MANIFEST))


def publish(tables: dict[str, DataFrame], root: str, audit: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> int:
    """Publish a set of tables (each with ``run_id``) as the next version and return its number.

    Runs that a table does not mention stay as published before. ``audit`` gets the whole new
    set as it will be read and returns its violations; any row stops the publication with a
    ValueError, and the version is never pointed to."""
    spark = next(iter(tables.values())).sparkSession
    last = published_version(spark, root)
    # a version that was begun and not published leaves its number unused
    begun = _read(spark, f"{root}/_begun", "version long").agg(F.max("version")).first()[0]
    v = max(last or 0, begun or 0) + 1
    spark.createDataFrame([(v,)], "version long").write.mode("append").parquet(f"{root}/_begun")
    for name, df in tables.items():
        if df.columns == ["run_id"]:
            df = df.withColumn(_ROW, F.lit(True))  # a file needs a column of its own
        df.withColumn("version", F.lit(v)).write.mode("append").partitionBy("version", "run_id").parquet(f"{root}/{name}")
    manifest = _read(spark, f"{root}/_manifest/version={last}", _MANIFEST) if last is not None else spark.createDataFrame([], _MANIFEST)
    touched = None
    for name, df in tables.items():
        t = df.select(F.lit(name).alias("table"), F.col("run_id").cast("long").alias("run_id")).distinct()
        touched = t if touched is None else touched.unionByName(t)
    kept = manifest.join(touched, ["table", "run_id"], "left_anti")
    kept.unionByName(touched.withColumn("from_version", F.lit(v).cast("long"))).write.parquet(f"{root}/_manifest/version={v}")
    manifest = _read(spark, f"{root}/_manifest/version={v}", _MANIFEST)
    names = sorted(r[0] for r in manifest.select("table").distinct().collect())
    if audit is not None:
        faults = audit({n: _at(spark, root, n, manifest) for n in names}).limit(5).collect()
        if faults:
            raise ValueError(f"version {v} is not published: {faults}")
    spark.createDataFrame([(v, names)], _POINTER).write.mode("append").parquet(f"{root}/_published")
    return v
