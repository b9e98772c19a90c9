"""Drive-shaped views over the supplied tables.

Each view is one list of SQL expressions that Spark and an ANSI engine read alike, so a
query and its check start from the same rows.  ``{us}`` stands for "ts in microseconds".
Fractional literals are written with an exponent: a plain 0.1 would be DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

US = {"spark": "unix_micros(cast(ts as timestamp))", "sql": "epoch_us(ts)"}
T0_US = 1704067200000000  # first instant of the events table

VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "poses_v": (
        "events",
        {
            "run_id": "user_id % 10",
            "seq": "event_id",
            "stamp_ns": "{us} * 1000",
            "x": f"({{us}} - {T0_US}) / 36e9",
            "y": "value * 2e-3",
            "z": "3e-1 + (event_id % 13) * 1e-2",
            "qx": "value * 1e-3",
            "qy": "(event_id % 7) * 1e-2",
            "qz": "(value - 50) * 1e-2",
            "qw": "1e0 + (event_id % 3) * 1e-1",
        },
        None,
    ),
    "points_v": (
        "lineitem",
        {
            "run_id": "l_suppkey % 10",
            "scan_id": "l_orderkey % 50",
            "x": "(l_partkey % 720) * 1e-1 + l_tax * 1e-1",
            "y": "(l_quantity - 25) * 16e-2 + l_discount * 1e-2",
            "z": "CASE WHEN l_linenumber <= 4 THEN l_discount * 5e-1 ELSE l_tax * 2e1 END",
            "intensity": "l_extendedprice / 1e3",
            "observation_count": "CAST(l_linenumber AS BIGINT)",
        },
        None,
    ),
    "links_v": (
        "orders",
        {
            "run_id": "o_orderkey % 10",
            "edge_id": "o_orderkey",
            "from_id": "o_custkey % 200",
            "to_id": "(o_orderkey * 7 + o_custkey) % 200",
            "length": "o_totalprice / 1e4",
            "passable": "o_orderstatus <> 'F'",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'INVALID' WHEN 'O' THEN 'VALID' ELSE 'WARNING' END",
        },
        "o_custkey % 200 <> (o_orderkey * 7 + o_custkey) % 200",
    ),
    "spans_v": (
        "part",
        {
            "feature_id": "p_partkey",
            "edge_id": "p_partkey % 50",
            "start_s": "p_size * 1e-1",
            "end_s": "p_size * 1e-1 + p_retailprice / 1e3",
            "type": "CASE WHEN p_partkey % 7 = 0 THEN 'no_entry' ELSE 'speed_limit' END",
            "value": "2e-1 + (p_size % 5) * 1e-1",
        },
        None,
    ),
    # wiggly lines of 50 vertices each, one edge per 50 consecutive events
    "samples_v": (
        "events",
        {
            "run_id": "CAST(floor(event_id / 5e1) AS BIGINT) % 10",
            "edge_id": "CAST(floor(event_id / 5e1) AS BIGINT)",
            "i": "event_id % 50",
            "x": "(event_id % 50) * 3e-1 + value * 1e-3 + CAST(floor(event_id / 5e1) AS BIGINT) % 7",
            "y": "value * 3e-3 + user_id * 1e-3 + CAST(floor(event_id / 5e1) AS BIGINT) % 11",
            "z": "(event_id % 17) * 1e-2",
        },
        None,
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Runtime settings the queries rely on: UTC, enough tasks for steps that multiply
    small inputs (AQE would otherwise merge them into one task by input bytes), and joins that
    broadcast by measured size only: a plan's estimate is the size of the file it reads, however
    many rows an ``explode`` makes of each. A union does not pass on its inputs' partitioning: once
    AQE has changed one side, the join above fails with "Can't zip RDDs"."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    base, columns, where = VIEWS[name]
    df = table(spark, sf_dir, base)
    if where:
        df = df.filter(where)
    return df.selectExpr(*[f"{e.format(us=US['spark'])} AS {n}" for n, e in columns.items()])


def view_sql(name: str) -> str:
    base, columns, where = VIEWS[name]
    items = ", ".join(f"{e.format(us=US['sql'])} AS {n}" for n, e in columns.items())
    return f"{name} AS (SELECT {items} FROM {base}{' WHERE ' + where if where else ''})"


def with_views(*names: str) -> str:
    """``WITH`` clause that opens a check query."""
    return "WITH " + ",\n".join(view_sql(n) for n in names)
