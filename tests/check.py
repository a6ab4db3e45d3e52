"""Run queries next to their SQL and compare row counts, column names and values."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortwise")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def compare(spark_df, connection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    ours = _rows(spark_df.columns, spark_df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}: {a} / {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark, connection = session(), duck(folder)
    wanted = sys.argv[2:]
    bad = []
    for name, build in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = build(spark, folder)
            outcome = compare(df, connection, sql) if sql else f"(no sql, {len(df.collect())} rows)"
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        ok = outcome is None or outcome.startswith("(no sql")
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {time.time() - start:6.2f}s {name} {outcome or ''}", flush=True)
    print("failed:", bad)
