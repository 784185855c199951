"""Results and provenance: stable sorting, pages, byte-range filters, coverage of bytes, typed export."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_PAGE, PAGE, WINDOW = 1024, 8192, 16_384
MOST_INTERVALS = 2_000_000
ORDINAL = "__ordinal"


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Number rows from 0 in the order of the given columns, without one task for all of them.

    Rows are dealt by ranges of the order; counts of ranges, one number for each, give where a range begins.
    """
    if not order:
        raise ValueError("an order is needed: a plan without one numbers rows differently each time")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order]
    dealt = df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()).persist()
    starts, total = {}, 0
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():
        starts[r["__part"]] = total
        total += r["count"]
    base = F.coalesce(F.get(F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(max(starts, default=0) + 1)]), F.col("__part")), F.lit(0))
    w = Window.partitionBy("__part").orderBy(*keys)
    return dealt.withColumn(ORDINAL, F.row_number().over(w) - 1 + base).drop("__part")


def sorted_view(result: DataFrame, column: int, descending: bool = False) -> DataFrame:
    """A numbered result ordered by its column of that position: nulls last either way, ties in the result's order."""
    name = [c for c in result.columns if c != ORDINAL][column]
    if isinstance(result.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType, T.TimestampType)):
        raise ValueError(f"{name} can't be sorted by")
    key = F.col(f"`{name}`")
    return result.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), ORDINAL)


def next_sort(now: tuple[int, bool] | None, column: int) -> tuple[int, bool] | None:
    """Ascending, descending, as it was; another column begins anew."""
    if now is None or now[0] != column:
        return column, False
    return (column, True) if not now[1] else None


def page(result: DataFrame, number: int) -> DataFrame:
    """Page 0 has FIRST_PAGE rows, each further one PAGE."""
    start = 0 if number == 0 else FIRST_PAGE + (number - 1) * PAGE
    return result.where((F.col(ORDINAL) >= start) & (F.col(ORDINAL) < start + (FIRST_PAGE if number == 0 else PAGE)))


def window(result: DataFrame, anchor: int, rows: int = WINDOW) -> DataFrame:
    """Rows around one."""
    start = max(0, anchor - rows // 2)
    return result.where((F.col(ORDINAL) >= start) & (F.col(ORDINAL) < start + rows))


def overlaps(start: int, end: int, ranges: bool = False) -> Column:
    whole = (F.col("_src_start") < end) & (F.col("_src_end") > start)
    if not ranges:
        return whole
    return whole & (F.col("_src_ranges").isNull() | F.exists("_src_ranges", lambda p: (p["start"] < end) & (p["end"] > start)))


def byte_range(df: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """Rows with bytes in [start, end) of a file."""
    have = [c.lower() for c in df.columns]
    for c in ("_src_file", "_src_start", "_src_end"):
        if have.count(c) != 1:
            raise ValueError(f"{c} is missing or not unique")
    return df.where((F.col("_src_file") == file) & overlaps(start, end, "_src_ranges" in have))


def merge_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching ranges of each key as one; empty ones go."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.where(F.col(start) < F.col(end)).withColumn("__new", F.when(F.col(start) <= before, 0).otherwise(1))
    return islands.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


BIN = 1 << 12


def covering(rows: DataFrame, probes: DataFrame, *, bin_bytes: int = BIN) -> DataFrame:
    """Rows (_src_file, _src_start, _src_end) that cover probes (_src_file, at), by bins of bytes instead of all pairs."""
    binned = rows.where("_src_start < _src_end").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("_src_start") / bin_bytes), F.floor((F.col("_src_end") - 1) / bin_bytes))))
    return probes.withColumn("__bin", F.floor(F.col("at") / bin_bytes)).join(binned, ["_src_file", "__bin"]).where("_src_start <= at and at < _src_end").drop("__bin")


def tightest(rows: DataFrame, probes: DataFrame, *ties: str) -> DataFrame:
    """Of each probe the smallest range that covers it; of equals the later start, then ``ties``."""
    w = Window.partitionBy("_src_file", "at").orderBy(F.col("_src_end") - F.col("_src_start"), F.desc("_src_start"), *ties)
    return covering(rows, probes).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def spans(rows: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """Ranges clipped to a window, with a shade that alternates by place in the file."""
    inside = byte_range(rows, file, start, end)
    w = Window.partitionBy("_src_file").orderBy("_src_start", "_src_end")
    return inside.withColumn("shade", (F.dense_rank().over(w) % 2).cast("int")).withColumn("from", F.greatest("_src_start", F.lit(start))).withColumn("to", F.least("_src_end", F.lit(end)))


def export_columns(df: DataFrame, provenance: bool = False) -> list[str]:
    """Columns to export; those that begin with _ only with provenance."""
    out = [c for c in df.columns if c != ORDINAL and (provenance or not c.startswith("_"))]
    if not out:
        raise ValueError("nothing to export")
    return out


def unique_labels(labels: list[str]) -> list[str]:
    """Names that differ without regard to case: _2, _3 for repeats, column_n for blanks."""
    out: list[str] = []
    for k, label in enumerate(labels, 1):
        name = base = label.strip() or f"column_{k}"
        n = 1
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def file_name(stem: str, ext: str) -> str:
    return (re.sub(r"[^A-Za-z0-9._-]+", "-", re.sub(r"\.[^.]*$", "", stem)).strip("-.") or "query") + f"-results.{ext}"


def csv_value(x) -> str:
    """Null is nothing, text is quoted, bytes are hexadecimal, ranges are a-b;c-d."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return '"' + x.replace('"', '""') + '"'
    if isinstance(x, (bytes, bytearray)):
        return "0x" + bytes(x).hex()
    if isinstance(x, dt.datetime):
        return x.isoformat(timespec="microseconds")
    if isinstance(x, list):
        return '"' + ";".join(f"{p['start']}-{p['end']}" for p in x) + '"'
    return str(x)


def csv_lines(df: DataFrame) -> DataFrame:
    """``line`` of each row, in its order (a numbered result keeps its number)."""
    columns = [c for c in df.columns if c != ORDINAL]
    numbered = ORDINAL in df.columns
    schema = T.StructType([T.StructField(ORDINAL, T.LongType()), T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([",".join(map(csv_value, r)) for r in zip(*cols, strict=True)], pa.string())], [ORDINAL, "line"])

    number = F.col(ORDINAL) if numbered else F.lit(0).cast("long").alias(ORDINAL)
    return df.select(number, *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def write_csv(df: DataFrame, path: str, provenance: bool = False) -> None:
    """A folder of text parts in the result's order: a byte-order mark and quoted heads first, lines end in CR LF."""
    columns = export_columns(df, provenance)
    head = "﻿" + ",".join(csv_value(c) for c in columns)
    lines = csv_lines(df.select(*([ORDINAL] if ORDINAL in df.columns else []), *columns))
    first = df.sparkSession.createDataFrame([(-1, head)], lines.schema)
    first.union(lines).orderBy(ORDINAL).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_parquet(df: DataFrame, path: str, provenance: bool = False) -> None:
    """Parquet with unique names, parts in the result's order."""
    columns = export_columns(df, provenance)
    ordered = df.orderBy(ORDINAL) if ORDINAL in df.columns else df
    ordered.select(*columns).toDF(*unique_labels(columns)).write.mode("overwrite").parquet(path)


#: Commands that only tell what is there.
_TELLS = re.compile(r"\.(?:Explain|Show|Describe|UnresolvedDescribe)\w*$")
#: Functions that call into the host.
_CALLS = re.compile(r"(?i)\b(?:java_method|reflect|try_reflect)\s*\(")


def _changes(spark: SparkSession, plan: Any) -> bool:
    """Whether a parsed plan holds anything but a query, at any depth."""
    load = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [load(logical + k) for k in ("Command", "ParsedStatement", "V2WriteCommand")]
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        if any(k.isInstance(node) for k in kinds) and not _TELLS.search(name):
            return True
        for x in (node.children(), node.innerChildren()):
            for k in range(x.size()):
                if load("org.apache.spark.sql.catalyst.plans.QueryPlan").isInstance(x.apply(k)):
                    todo.append(x.apply(k))
    return False


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """A query. What is asked for is parsed, and refused if anything in it changes something or calls into the host."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if _changes(spark, plan) or _CALLS.search(re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)):
        raise PermissionError("only queries are run")
    return spark.sql(text)


HEADER = "-- binframe-queries v1"
MOST_FILE, MOST_QUERY = 1 << 20, 64 << 10


def dump_queries(format_: str, queries: list[tuple[str, str]]) -> str:
    """A file of named queries."""
    safe = lambda s: s.replace("\\", "\\\\").replace("\n", "\\n")
    return "\n".join([HEADER, f"-- format: {safe(format_)}", *(f"\n-- name: {safe(n)}\n{q.strip()}" for n, q in queries)]) + "\n"


def load_queries(text: str) -> tuple[str, list[tuple[str, str]]]:
    if len(text.encode()) > MOST_FILE or not text.startswith(HEADER):
        raise ValueError("not a file of queries, or too long")
    plain = lambda s: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s)
    head, *blocks = re.split(r"(?m)^-- name: ", text)
    kind = re.search(r"(?m)^-- format: (.*)$", head)
    out = []
    for b in blocks:
        name, _, sql = b.partition("\n")
        if len(sql.encode()) > MOST_QUERY:
            raise ValueError(f"{name}: too long")
        out.append((plain(name), sql.strip()))
    return plain(kind[1]) if kind else "", out
