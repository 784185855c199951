"""Compares a query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(DATA, sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return dt.datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if isinstance(x, dict):
        return tuple(map(_plain, x.values()))
    return x


def compare(spark, name, query, sql, sf="sf0.001") -> str | None:
    df = query(spark, f"{DATA}/{sf}")
    c = connect(sf)
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    rows = [tuple(_plain(r[names.index(k)]) for k in order) for r in want.fetchall()]
    got = [tuple(_plain(r[k]) for k in order) for r in df.collect()]
    if len(rows) != len(got):
        return f"{name}: {len(got)} rows, wanted {len(rows)}"
    key = lambda r: tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        if a != b:
            return f"{name}: {a} and {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sqls = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or sqls:
        try:
            print(compare(spark, n, queries[n], sqls[n], sys.argv[1]) or f"{n}: same", flush=True)
        except Exception as x:  # noqa: BLE001
            print(f"{n}: {type(x).__name__} {str(x)[:300]}", flush=True)
