"""Run registered queries beside their SQL checks and compare rows exactly.

Usage: python tests/compare.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(t) -> str:
    t = str(t)
    return {"large_string": "string"}.get(t, t)


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = list(zip(*cols)) if cols else []
    return names, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_table, sql_table) -> str | None:
    """None when equal, else a short description."""
    a = {n: kind(spark_table.schema.field(n).type) for n in spark_table.column_names}
    b = {n: kind(sql_table.schema.field(n).type) for n in sql_table.column_names}
    if a != b:
        return f"schema {sorted(set(a.items()) ^ set(b.items()))}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} != {sql_table.num_rows}"
    names, ra = rows_of(spark_table)
    _, rb = rows_of(sql_table)
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    if bad:
        return f"{len(bad)} of {len(ra)} rows differ; {names}: spark {bad[0][0]} sql {bad[0][1]}"
    return None


def main() -> int:
    import __spark_entry__
    from drivegrid.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("parts", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                       "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    checks = __spark_entry__.oracle_sql()
    failed = []
    for name, fn in __spark_entry__.queries().items():
        if args.parts and not any(p in name for p in args.parts):
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
            took = time.time() - t
            note = "no check"
            if name in checks:
                want = con.execute(checks[name]).to_arrow_table()
                note = difference(got, want) or "ok"
            if note not in ("ok", "no check"):
                failed.append(name)
            print(f"@@ {name:34s} {got.num_rows:8d} rows {took:6.2f}s {time.time()-t-took:6.2f}s {note}", flush=True)
        except Exception as exc:  # noqa: BLE001
            failed.append(name)
            text = " ".join(str(exc).split("JVM stacktrace")[0][:900].split()) if not os.environ.get("TRACE") else traceback.format_exc()
            print(f"@@ {name:34s} ERROR {type(exc).__name__}: {text}", flush=True)
    print("@@ failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
