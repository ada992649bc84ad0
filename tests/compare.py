"""Holds queries against their SQL in DuckDB: python tests/compare.py [DIR] [NAME...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def spark_session() -> SparkSession:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return x


def bag(rows: list, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def views(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differ(spark: SparkSession, con: duckdb.DuckDBPyConnection, d: str, query, sql: str) -> str:
    """Empty if the results are equal."""
    df = query(spark, d)
    got = bag(df.collect(), df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = bag(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} {names}"
    return "" if got == want else f"{sum(got.values())} rows, {sum(want.values())} wanted; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = spark_session(), views(d), 0
    sql, queries = entry.oracle_sql(), entry.queries()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            why = differ(spark, con, d, queries[name], sql[name])
        except Exception:  # noqa: BLE001
            why = traceback.format_exc()[-700:]
        bad += bool(why)
        print(f"{name}: {'ok' if not why else why[:900]} ({time.time() - t:.1f} s)", flush=True)
    print("differ:", bad)
