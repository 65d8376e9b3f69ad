"""Run registered queries beside their SQL and compare the rows.

``python -m verification.check [--sf DIR] [name ...]``
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    """One spelling for values the two engines type differently."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, Decimal)):
        return repr(float(value))
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plained = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(plained, key=lambda row: tuple((v is None, str(v)) for v in row))


def same_but_last_digit(a, b) -> bool:
    """Equal, or numbers one unit of their last digit apart: a sum that lies on half a unit
    is rounded by the order of its additions."""
    if a == b:
        return True
    try:
        difference = abs(float(a) - float(b))
    except (TypeError, ValueError):
        return False
    digits = max(len(x.partition(".")[2]) for x in (a, b))
    return "e" not in a + b and difference <= 1.01 * 10.0**-digits


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def compare(spark: SparkSession, connection, function, sql: str, sf_dir: str) -> tuple[str, float, float]:
    """``ok`` or what differs, with the seconds each engine took."""
    started = time.time()
    frame = function(spark, sf_dir)
    got = as_rows(frame.columns, frame.collect())
    middle = time.time()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = as_rows(names, cursor.fetchall())
    ended = time.time()
    times = middle - started, ended - middle
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(set(frame.columns) ^ set(names))}", *times
    if got == want:
        return f"ok {len(got)} rows", *times
    if len(got) == len(want) and all(
        same_but_last_digit(x, y) for ours, theirs in zip(got, want) for x, y in zip(ours, theirs)
    ):
        return f"ok {len(got)} rows, last digits apart", *times
    ours, theirs = set(got), set(want)
    extra = [r for r in got if r not in theirs][:3]
    lacking = [r for r in want if r not in ours][:3]
    return f"DIFFERS in {len(ours - theirs)}, {len(got)} vs {len(want)} rows\n  {sorted(names)}\n  spark {extra}\n  sql   {lacking}", *times


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("costlens-check")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> int:
    from . import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = session()
    connection = duck(options.sf)
    bad = 0
    for name in options.names or list(QUERIES):
        if name in ORACLES:
            try:
                verdict, ours, theirs = compare(spark, connection, QUERIES[name], ORACLES[name], options.sf)
            except Exception as error:  # report it and go on with the next query
                verdict, ours, theirs = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
        else:
            started = time.time()
            verdict = f"rows {QUERIES[name](spark, options.sf).count()}"
            ours, theirs = time.time() - started, 0.0
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:32s} {ours:6.2f}s {theirs:6.2f}s {verdict}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
