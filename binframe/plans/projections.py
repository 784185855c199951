"""Projections, expressions, provenance and result services over rows nested from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binframe.operators import projection, results


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames: an order with its lines as a nested document, dealt to four files."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(F.col("l_linenumber").alias("lineNumber"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    # Repeated line numbers within an order are told apart by the rest of the line.
    docs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return docs.select((F.col("l_orderkey") % 4).cast("string").alias("_src_file"), F.col("l_orderkey").alias("ordinal"), F.struct(F.col("l_orderkey").alias("order_id"), "items").alias("root"), (F.col("l_orderkey") * 64).alias("_src_start"), (F.col("l_orderkey") * 64 + 64).alias("_src_end"))


def _project(table: dict) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        (compiled,) = projection.compile_spec({"version": "0.5", "tables": [table]})
        return projection.project(_orders(spark, sf_dir), compiled).drop("_src_start", "_src_end", "_src_file")

    return query


def _column(name: str, type_: str, expr: str, when: str | None = None) -> dict:
    return {"name": name, "type": type_, "expr": expr} | ({"when": when} if when else {})


_ID = [_column("order_id", "int64", "_root.order_id"), _column("pos", "int64", "_index(0)")]
_LINES = """WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS part, CAST(trunc(l_quantity) AS BIGINT) AS quantity, l_returnflag AS flag, l_extendedprice AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(trunc(l_quantity) AS BIGINT), l_returnflag, l_extendedprice) - 1 AS pos FROM lineitem) """
_WRAP8 = "CAST(((({0}) % 256 + 256 + 128) % 256) - 128 AS TINYINT)"

TABLES: dict[str, tuple[dict, str]] = {
    "anchor_explode": ({"name": "lines", "rows": "$.items[*]", "columns": [*_ID, _column("part", "uint32", "_.part"), _column("siblings", "int32", "len(_root.items)")]}, _LINES + "SELECT order_id, pos, part, CAST(count(*) OVER (PARTITION BY order_id) AS INTEGER) AS siblings FROM l"),
    "anchor_index": ({"name": "second", "rows": "$.items[1]", "columns": [_column("order_id", "int64", "_root.order_id"), _column("part", "int64", "_.part")]}, _LINES + "SELECT order_id, part FROM l WHERE pos = 1"),
    "expr_columns": ({"name": "e", "rows": "$.items[*]", "columns": [
        *_ID, _column("sum", "int64", "_.part + _.quantity * 2 - 1"), _column("ratio", "utf8", "_.part / 2 == 10 ? 'ten' : 'other'"), _column("rest", "int64", "_.part % 7"), _column("bits", "int64", "(_.part & 0xff) | 1 ^ 6"),
        _column("moved", "int64", "_.part << 3 >> 1"), _column("small", "int8", "_.part"), _column("byte", "uint8", "_.part * 3"), _column("label", "utf8", "_.flag + '-' + _.line_number"), _column("gone", "int64", "_.nothing + 1"),
        _column("cond", "bool", "_.quantity > 25 and not (_.flag == 'R')"), _column("text", "utf8", "enum_str(_.quantity)"), _column("size", "int32", "len(_.flag)"), _column("back", "int64", "to_i('0' + _.quantity)"),
    ]}, _LINES + f"SELECT order_id, pos, part + quantity * 2 - 1 AS sum, CASE WHEN part / 2 = 10 THEN 'ten' ELSE 'other' END AS ratio, part % 7 AS rest, (part & 255) | xor(1, 6) AS bits, (part << 3) >> 1 AS moved, {_WRAP8.format('part')} AS small, CAST((part * 3) % 256 AS SMALLINT) AS byte, flag || '-' || line_number AS label, CAST(NULL AS BIGINT) AS gone, quantity > 25 AND NOT (flag = 'R') AS cond, CAST(quantity AS VARCHAR) AS text, CAST(length(flag) AS INTEGER) AS size, quantity AS back FROM l"),
    "when_guard": ({"name": "w", "rows": "$.items[*]", "columns": [*_ID, _column("big", "int64", "_.part", "_.quantity >= 30"), _column("flag", "utf8", "_.flag", "_.flag != 'N'")]}, _LINES + "SELECT order_id, pos, CASE WHEN quantity >= 30 THEN part END AS big, CASE WHEN flag <> 'N' THEN flag END AS flag FROM l"),
    "state_accumulator": ({"name": "s", "rows": "$.items[*]", "state": [{"name": "total", "scope": "$", "init": "0", "update": "total + _.quantity"}], "columns": [*_ID, _column("total", "int64", "total")]}, _LINES + "SELECT order_id, pos, CAST(sum(quantity) OVER (PARTITION BY order_id % 4 ORDER BY order_id, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM l"),
    "state_reset_per_parent": ({"name": "s", "rows": "$.items[*]", "state": [{"name": "top", "scope": "$.items", "init": "0", "update": "_.quantity > top ? _.quantity : top"}, {"name": "n", "scope": "$.items", "init": "10", "update": "n + (_.quantity == top ? 1 : 0)"}], "columns": [*_ID, _column("top", "int64", "top"), _column("n", "int64", "n")]}, _LINES + ", m AS (SELECT *, max(quantity) OVER (PARTITION BY order_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS top FROM l) SELECT order_id, pos, top, CAST(10 + sum(CASE WHEN quantity = top THEN 1 ELSE 0 END) OVER (PARTITION BY order_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM m"),
    "where_after_state": ({"name": "s", "rows": "$.items[*]", "key": "row_id", "where": "_.flag == 'R'", "state": [{"name": "total", "scope": "$.items", "init": "0", "update": "total + _.quantity"}], "columns": [*_ID, _column("total", "int64", "total")]}, _LINES + ", t AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY order_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM l) SELECT row_number() OVER (PARTITION BY order_id % 4 ORDER BY order_id, pos) AS row_id, order_id, pos, total FROM t WHERE flag = 'R'"),
    "synthetic_key": ({"name": "k", "rows": "$.items[*]", "key": "line_id", "columns": _ID}, _LINES + "SELECT row_number() OVER (PARTITION BY order_id % 4 ORDER BY order_id, pos) AS line_id, order_id, pos FROM l"),
}


def parent_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children carry their parent's key; no join is needed to find it, and one on (key, file) gives the parent back."""
    frames = _orders(spark, sf_dir)
    parents, children = projection.compile_spec({"tables": [{"name": "p", "rows": "$", "key": "p_id", "columns": [_column("order_id", "int64", "_.order_id")]}, {"name": "c", "rows": "$.items[*]", "parent": "p_id", "columns": [_column("part", "int64", "_.part")]}]})
    p = projection.project(frames, parents)
    keyed = frames.join(p.select("p_id", "_src_file", F.col("order_id").alias("ordinal")), ["_src_file", "ordinal"])
    c = projection.project(keyed, children)
    return c.join(p.select("p_id", "_src_file", "order_id"), ["p_id", "_src_file"]).groupBy("order_id").agg(F.count("*").alias("n"), F.sum("part").alias("parts"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.col("l_partkey") * 8
    end = start + F.col("l_quantity").cast("long")
    pieces = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.struct(start.alias("start"), (start + 2).alias("end")), F.struct((end - 1).alias("start"), end.alias("end"))))
    return lines.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("_src_file"), start.alias("_src_start"), end.alias("_src_end"), pieces.alias("_src_ranges"))


_R = "WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_partkey * 8 AS s, l_partkey * 8 + CAST(trunc(l_quantity) AS BIGINT) AS e FROM lineitem) "


def byte_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.byte_range(_ranges(spark, sf_dir), "A", 400, 900).select("l_orderkey", "l_linenumber", "_src_start", "_src_end")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("_src_file"), (F.col("p_partkey") * 8 + 3).alias("at"))


def coverage_rows_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.covering(_ranges(spark, sf_dir), _probes(spark, sf_dir)).select(F.col("_src_file").alias("file"), "at", "l_orderkey", "l_linenumber", "_src_start")


def coverage_range_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.tightest(_ranges(spark, sf_dir), _probes(spark, sf_dir)).select(F.col("_src_file").alias("file"), "at", "_src_start", "_src_end")


def coverage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.spans(_ranges(spark, sf_dir).drop("_src_ranges"), "R", 1000, 1500).select("l_orderkey", "l_linenumber", "shade", "from", "to")


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir).select(F.col("_src_file").alias("file"), F.col("_src_start").alias("start"), F.col("_src_end").alias("end"))
    return results.merge_ranges(r, ["file"])


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_totalprice")
    return results.with_ordinal(orders, "o_orderkey")


def _sorted(descending: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import Window

        view = results.sorted_view(_numbered(spark, sf_dir), 1, descending)
        # The rank shows the order to a comparison that doesn't look at rows' places; it is asked for within each status.
        key = F.col("status").desc_nulls_last() if descending else F.col("status").asc_nulls_last()
        return view.select("o_orderkey", "status", F.row_number().over(Window.partitionBy("status").orderBy(key, results.ORDINAL)).alias("place"))

    return query


def paged_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page(_numbered(spark, sf_dir), 1).select("o_orderkey", F.col(results.ORDINAL).alias("ordinal"))


def result_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.window(_numbered(spark, sf_dir), 700, 100).select("o_orderkey", F.col(results.ORDINAL).alias("ordinal"))


def csv_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.nullif("n_name", F.lit("x")).alias("n"), F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("r"), F.encode("n_name", "utf-8").alias("b"), (F.col("n_regionkey") == 1).alias("t"))
    return results.csv_lines(n).select("line")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {k: (_project(t), s) for k, (t, s) in TABLES.items()} | {
    "parent_key_join": (parent_key_join, "SELECT l_orderkey AS order_id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1"),
    "byte_range_filter": (byte_range_filter, _R + "SELECT l_orderkey, l_linenumber, s AS _src_start, e AS _src_end FROM r WHERE f = 'A' AND s < 900 AND e > 400 AND (l_linenumber % 2 <> 0 OR (s < 900 AND s + 2 > 400) OR (e - 1 < 900 AND e > 400))"),
    "coverage_rows_at": (coverage_rows_at, _R + "SELECT f AS file, p.\"at\", l_orderkey, l_linenumber, s AS _src_start FROM r JOIN (SELECT p_partkey * 8 + 3 AS \"at\" FROM part) p ON s <= p.\"at\" AND p.\"at\" < e"),
    "coverage_range_at": (coverage_range_at, _R + "SELECT DISTINCT file, \"at\", _src_start, _src_end FROM (SELECT f AS file, p.\"at\", s AS _src_start, e AS _src_end, row_number() OVER (PARTITION BY f, p.\"at\" ORDER BY e - s, s DESC) AS k FROM r JOIN (SELECT p_partkey * 8 + 3 AS \"at\" FROM part) p ON s <= p.\"at\" AND p.\"at\" < e) x WHERE k = 1"),
    "coverage_spans": (coverage_spans, _R + 'SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY s, e) % 2 AS INTEGER) AS shade, greatest(s, 1000) AS "from", least(e, 1500) AS "to" FROM r WHERE f = \'R\' AND s < 1500 AND e > 1000'),
    "merge_ranges": (merge_ranges, _R + ', o AS (SELECT f, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY f ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r WHERE s < e) SELECT f AS file, min(s) AS "start", max(e) AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY f ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o) x GROUP BY f, g'),
    "result_sort_asc": (_sorted(False), "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, CAST(row_number() OVER (PARTITION BY nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS INTEGER) AS place FROM orders"),
    "result_sort_desc": (_sorted(True), "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, CAST(row_number() OVER (PARTITION BY nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS INTEGER) AS place FROM orders"),
    "paged_result": (paged_result, "SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders) x WHERE ordinal >= 1024 AND ordinal < 9216"),
    "result_window": (result_window, "SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders) x WHERE ordinal >= 650 AND ordinal < 750"),
    "csv_encode": (csv_encode, """SELECT n_nationkey || ',"' || n_name || '",' || CASE WHEN n_regionkey > 2 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END || ',0x' || lower(hex(encode(n_name))) || ',' || CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END AS line FROM nation"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items()}
