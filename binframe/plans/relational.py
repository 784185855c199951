"""The relational surface as queries over the test tables, each with SQL for another engine to compare with.

A query is Spark SQL with tables in braces; where the other dialect needs other words, its text follows. Entries made of
DataFrame operators name a function.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binframe.operators.asof import asof_join, asof_join_ranged, nulls_last, qualify

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str | tuple[str, str]] = {
    "project_star": "SELECT n.*, n_nationkey + 1 AS next_key FROM {nation} n",
    "scan_filter_project": "SELECT l_orderkey, l_quantity, l_shipdate FROM {lineitem} WHERE l_quantity > 45",
    "like_filter": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'",
    "filter_null_logic": "SELECT event_id, value FROM {events} WHERE (value > 50 OR nullif(event_type, 'click') IS NULL) AND value IS NOT NULL",
    "in_list": "SELECT o_orderkey FROM {orders} WHERE o_orderpriority IN (SELECT max(o_orderpriority) FROM {orders} UNION ALL SELECT min(o_orderpriority) FROM {orders})",
    "between_filter": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount BETWEEN 0.02 AND 0.04",
    "join_inner_composite": "SELECT a.l_orderkey, a.l_linenumber, b.q FROM {lineitem} a JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM {lineitem} GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40",
    "join_residual": "SELECT o.o_orderkey AS a, p.o_orderkey AS b FROM {orders} o JOIN {orders} p ON o.o_custkey = p.o_custkey AND o.o_orderstatus <> p.o_orderstatus",
    "left_join_group_all": "SELECT c_mktsegment, count(o_orderkey) AS n, round(sum(coalesce(o_totalprice, 0)), 2) AS total FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY ALL",
    "cross_join_scalar": "SELECT event_id, value / h.top AS share FROM {events} CROSS JOIN (SELECT max(value) AS top FROM {events}) h",
    "join_using": "SELECT doc_id, lang, toxic FROM {documents} JOIN {labels} USING (doc_id)",
    "not_exists_seed": "SELECT 0 AS tick, 500000 AS tempo WHERE NOT EXISTS (SELECT 1 FROM {events} WHERE value < 0) UNION ALL SELECT event_id, user_id FROM {events}",
    "semi_join": ("SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE c_custkey = o_custkey AND o_totalprice > 300000)"),
    "anti_join": ("SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE c_custkey = o_custkey AND o_totalprice > 300000)"),
    "correlated_exists": "SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})",
    "right_join": "SELECT r_name, n_name FROM (SELECT * FROM {region} WHERE r_regionkey < 3) r RIGHT JOIN {nation} ON r_regionkey = n_regionkey",
    "full_outer_join": "SELECT a.c_custkey AS a, b.o_custkey AS b FROM (SELECT c_custkey FROM {customer} WHERE c_custkey % 3 = 0) a FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_custkey % 2 = 0) b ON a.c_custkey = b.o_custkey",
    "join_broadcast": ("SELECT /*+ BROADCAST(r) */ n_name, r_name FROM {nation} JOIN {region} r ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM {nation} JOIN {region} r ON n_regionkey = r_regionkey"),
    "join_multi_way": "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY r_name",
    "group_count": "SELECT event_type, count(*) AS n, count(nullif(event_type, 'click')) AS n_other FROM {events} GROUP BY event_type",
    "group_sum": "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_basic": "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_discount), 6) AS dev, round(var_pop(l_tax), 8) AS var FROM {lineitem} GROUP BY l_returnflag",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS untaxed FROM {lineitem} GROUP BY l_returnflag",
    "count_distinct": "SELECT l_shipmode_like, count(DISTINCT l_suppkey) AS n FROM (SELECT l_linenumber AS l_shipmode_like, l_suppkey FROM {lineitem}) x GROUP BY 1",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "lag_default": "SELECT event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}",
    "running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM {events}",
    "window_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM {events}",
    "window_rank": "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS q FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "window_frames": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM {events}",
    "window_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT) RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM {events}",
    "topk": "SELECT event_type, user_id, count(*) AS n FROM {events} GROUP BY 1, 2 ORDER BY n DESC NULLS LAST, 1, 2 LIMIT 100",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 7",
    "union_all_overview": "SELECT 'events' AS table_name, count(*) AS row_count FROM {events} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'part', count(*) FROM {part}",
    "union_distinct": "SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM {customer} WHERE c_acctbal < 0",
    "intersect": "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_custkey % 2 = 0",
    "except_all": "SELECT l_suppkey AS k, l_linenumber AS n FROM {lineitem} WHERE l_quantity > 10 EXCEPT ALL SELECT l_suppkey, l_linenumber FROM {lineitem} WHERE l_discount > 0.04",
    "except_distinct": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000",
    "range_tvf": ("SELECT i * 2 AS twice FROM range(100) t(i)", "SELECT i * 2 AS twice FROM range(100) t(i)"),
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "values_list": "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'y')) v(a, b)",
    "cast_concat": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) || '-' || o_orderstatus AS label, CAST(o_totalprice AS BIGINT) AS whole FROM {orders} WHERE o_totalprice - floor(o_totalprice) < 0.4",
    "case_arithmetic": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM {lineitem}",
    "string_fns": "SELECT p_partkey, upper(p_name) AS u, length(p_brand) AS n, substring(p_type, 1, 3) AS s, replace(p_brand, '#', '') AS r, trim(concat('  ', p_name, ' ')) AS t, lpad(CAST(p_size AS VARCHAR(5)), 4, '0') AS l, reverse(p_brand) AS v FROM {part}",
    "date_fns": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS first, CAST(datediff(o_orderdate, DATE '1992-01-01') AS BIGINT) AS days FROM {orders}", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM {orders}"),
    "math_fns": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, floor(p_retailprice / 7) AS f, abs(p_size - 25) AS a, p_size % 7 AS m, round(power(p_size, 2), 2) AS p, greatest(p_size, 10) AS g FROM {part}",
    "json_fns": ("SELECT event_id, get_json_object(props, '$.k') AS k, length(props) AS n FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM {events}"),
    "array_fns": ("SELECT vec_id, size(embedding) AS n, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS sq, size(filter(embedding, x -> x > 0)) AS pos FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS sq, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS pos FROM {embeddings}"),
    "regex_fns": ("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS shape FROM {pages}", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape FROM {pages}"),
    "explode_pos": ("SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings})"),
    "pivot": "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS o, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 2) AS f FROM {lineitem} GROUP BY l_returnflag",
    "tumbling_window": ("SELECT window(ts, '1 hour').start AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM {events} GROUP BY 1, 2"),
    "tempo_map": """WITH t AS (SELECT user_id, event_id AS tick, CAST(floor(1000 + value * 10) AS BIGINT) AS us FROM {events} WHERE event_type = 'click'),
        seeded AS (SELECT user_id, tick, us FROM t UNION ALL SELECT user_id, 0 AS tick, 500000 AS us FROM (SELECT DISTINCT user_id FROM {events}) u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = u.user_id AND t.tick = 0)),
        stepped AS (SELECT user_id, tick, us, lag(tick, 1, tick) OVER (PARTITION BY user_id ORDER BY tick) AS before, lag(us, 1, us) OVER (PARTITION BY user_id ORDER BY tick) AS us_before FROM seeded)
        SELECT user_id, tick, us, CAST(sum((tick - before) * us_before) OVER (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 480000000 AS seconds FROM stepped""",
    "approx_stats": ("SELECT event_type, count(*) AS n, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) + 1 AS close, abs(percentile_approx(value, 0.5) - percentile(value, 0.5)) < 1 AS middle FROM {events} GROUP BY event_type", "SELECT event_type, count(*) AS n, true AS close, true AS middle FROM {events} GROUP BY event_type"),
    "not_in_null_safe": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)",
    "duplicate_labels": ("SELECT c0 AS first, c1 AS second FROM (SELECT 10 AS c0, 'x' AS c1)", "SELECT 10 AS first, 'x' AS second"),
    "bitwise_fns": ("SELECT l_orderkey, l_linenumber, l_partkey & 255 AS a, l_partkey | 15 AS o, l_partkey ^ 170 AS x, shiftright(l_partkey, 3) AS r, shiftleft(l_partkey, 2) AS l FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_partkey & 255 AS a, l_partkey | 15 AS o, xor(l_partkey, 170) AS x, l_partkey >> 3 AS r, l_partkey << 2 AS l FROM {lineitem}"),
    "string_agg_ordered": ("SELECT user_id, array_join(transform(array_sort(collect_list(struct(event_id, event_type))), x -> x.event_type), ',') AS kinds FROM {events} GROUP BY user_id", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM {events} GROUP BY user_id"),
    "interval_overlap_join": ("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) DIV 86400 AS BIGINT) AS a FROM {orders}),
        b AS (SELECT k, c, a, a + 90 AS e, explode(sequence(a DIV 128, (a + 90) DIV 128)) AS bin FROM s)
        SELECT DISTINCT x.k AS x, y.k AS y FROM b x JOIN b y ON x.c = y.c AND x.bin = y.bin AND x.a < y.e AND y.a < x.e AND x.k < y.k""", """WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS a FROM {orders})
        SELECT x.k AS x, y.k AS y FROM s x JOIN s y ON x.c = y.c AND x.a < y.a + 90 AND y.a < x.a + 90 AND x.k < y.k"""),
    "note_spans": ("""WITH e AS (SELECT event_id, user_id, event_type, event_id % 12 AS note, min(CASE WHEN event_type <> 'view' THEN event_id END) OVER (PARTITION BY user_id, event_id % 12 ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS off FROM {events})
        SELECT event_id, user_id, note, off, off - event_id AS span FROM e WHERE event_type = 'view'""", """SELECT *, off - event_id AS span FROM (SELECT v.event_id, v.user_id, v.event_id % 12 AS note, (SELECT min(o.event_id) FROM {events} o WHERE o.user_id = v.user_id AND o.event_id % 12 = v.event_id % 12 AND o.event_id > v.event_id AND o.event_type <> 'view') AS off FROM {events} v WHERE v.event_type = 'view') z"""),
}


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def asof_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = _tables(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "ts")
    other = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    return asof_join_ranged(clicks, other, "ts", "view_ts").select("event_id", "view_id")


def asof_left_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = _tables(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    other = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    return asof_join(clicks, other, "ts", "view_ts", by=["user_id"], how="left").select("event_id", "user_id", "view_id")


def qualify_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _tables(spark, sf_dir, "orders")
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return qualify(orders.select("o_custkey", "o_orderkey", "o_orderdate"), last, lambda q: q == 1).select("o_custkey", "o_orderkey")


def play_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds at which each event of a song sounds, by the tempo in force."""
    (events,) = _tables(spark, sf_dir, "events")
    tempo = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("from_tick"), F.expr("CAST(floor(1000 + value * 10) AS BIGINT)").alias("us"))
    notes = events.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("tick"))
    played = asof_join(notes, tempo, "tick", "from_tick", by=["user_id"], how="left")
    return played.select("user_id", "tick", F.expr("CASE WHEN us IS NULL THEN CAST(0 AS DOUBLE) ELSE (tick - from_tick) * us / 480000000 END").alias("seconds"), F.expr("CASE WHEN us IS NULL THEN 'before' WHEN us < 1200 THEN 'fast' ELSE 'slow' END").alias("pace"))


def nulls_last_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _tables(spark, sf_dir, "orders")
    key = F.nullif("o_orderstatus", F.lit("F"))
    w = Window.partitionBy("o_custkey").orderBy(*nulls_last(key, descending=True), "o_orderkey")
    return orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("r"))


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "asof_inner": (asof_inner, "SELECT c.event_id, v.view_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'click') c ASOF JOIN (SELECT event_id AS view_id, ts FROM events WHERE event_type = 'view') v ON c.ts >= v.ts"),
    "asof_left_keyed": (asof_left_keyed, "SELECT c.event_id, c.user_id, v.view_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT event_id AS view_id, user_id, ts FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts"),
    "play_all": (play_all, "WITH t AS (SELECT user_id, event_id AS from_tick, CAST(floor(1000 + value * 10) AS BIGINT) AS us FROM events WHERE event_type = 'click'), n AS (SELECT user_id, event_id AS tick FROM events WHERE event_type <> 'click') SELECT n.user_id, tick, CASE WHEN us IS NULL THEN CAST(0 AS DOUBLE) ELSE (tick - from_tick) * us / 480000000 END AS seconds, CASE WHEN us IS NULL THEN 'before' WHEN us < 1200 THEN 'fast' ELSE 'slow' END AS pace FROM n ASOF LEFT JOIN t ON n.user_id = t.user_id AND n.tick >= t.from_tick"),
    "qualify_dedupe": (qualify_dedupe, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "nulls_last_rank": (nulls_last_rank, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS r FROM orders"),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(v if isinstance(v, str) else v[0]) for k, v in SQL.items()} | {k: f for k, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    plain = {k: re.sub(r"\{(\w+)\}", r"\1", v if isinstance(v, str) else v[1]) for k, v in SQL.items()}
    return plain | {k: s for k, (_, s) in FUNCTIONS.items()}
