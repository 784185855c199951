import datetime as dt

import pytest

from binframe.operators import results as r
from binframe.operators.asof import asof_join, asof_join_ranged


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 9)], "l long, t long")
    right = spark.createDataFrame([("a", 5), ("b", 5), ("c", None), ("d", 7)], "r string, u long")
    for how, want in (("inner", [(1, "b"), (4, "d")]), ("left", [(1, "b"), (2, None), (3, None), (4, "d")])):
        assert sorted((x.l, x.r) for x in asof_join(left, right, "t", "u", how=how).collect()) == want
        assert sorted((x.l, x.r) for x in asof_join_ranged(left, right, "t", "u", how=how, ranges=3).collect()) == want
    assert asof_join(left.limit(0), right, "t", "u").count() == 0


def test_sort_cycle():
    assert r.next_sort(None, 1) == (1, False) and r.next_sort((1, False), 1) == (1, True) and r.next_sort((1, True), 1) is None and r.next_sort((1, True), 2) == (2, False)


def test_ordinals_are_dense(spark):
    df = r.with_ordinal(spark.range(5000).selectExpr("(id * 7919) % 5000 as k"), "k")
    assert df.where(f"k <> {r.ORDINAL}").count() == 0


def test_names_and_columns(spark):
    assert r.unique_labels(["a", "A", "", "a", "a_2"]) == ["a", "A_2", "column_3", "a_3", "a_2_2"]
    assert r.file_name("my song.mid", "csv") == "my-song-results.csv" and r.file_name("", "csv") == "query-results.csv"
    df = spark.createDataFrame([(1, 2)], "a int, _src_start int")
    assert r.export_columns(df) == ["a"] and r.export_columns(df, True) == ["a", "_src_start"]
    with pytest.raises(ValueError):
        r.export_columns(df.select("_src_start"))


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('q"', None, b"\1", True, dt.datetime(2020, 1, 2), [(1, 2), (3, 4)]), ("", 5, None, False, None, None)], "s string, n int, b binary, t boolean, d timestamp_ntz, p array<struct<start:long,end:long>>")
    lines = sorted(x.line for x in r.csv_lines(df).collect())
    assert lines == ['"",5,,false,,', '"q""",,0x01,true,2020-01-02T00:00:00.000000,"1-2;3-4"']
    r.write_csv(r.with_ordinal(df.select("s", "n"), "n"), f"{tmp_path}/c")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part*")))
    assert text.decode() == '﻿"s","n"\r\n"",5\r\n"q""",\r\n'
    r.write_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_only_queries(spark):
    assert r.run_sql(spark, "-- note\n select 1 as a").first().a == 1
    spark.sql("create table if not exists only_queries (id bigint) using parquet")
    spark.sql("insert into only_queries values (41)")
    refused = ["drop table only_queries", "WITH t AS (SELECT 1 AS id) INSERT INTO only_queries SELECT * FROM t", "FROM range(3) INSERT INTO only_queries SELECT id", "insert overwrite only_queries select 1", "create view v as select 1", "set a=b", "cache table only_queries", "FROM range(3) INSERT INTO only_queries SELECT id INSERT INTO only_queries SELECT id + 1", "select java_method('java.lang.System', 'exit', 1)", "begin select 1; end"]
    for text in refused:
        with pytest.raises(PermissionError):
            r.run_sql(spark, text)
    assert [x.id for x in spark.table("only_queries").collect()] == [41]
    for text in ("with t as (select id from only_queries) select * from t where id in (select 41)", "values (1)", "select 'insert into x; reflect(1)'", "explain select 1", "show tables", "describe only_queries", "from range(2) select id"):
        r.run_sql(spark, text).collect()
    spark.sql("drop table only_queries")


def test_query_files():
    text = r.dump_queries("capture", [("a\nb\\c", "select 1"), ("d", "select\n2")])
    assert r.load_queries(text) == ("capture", [("a\nb\\c", "select 1"), ("d", "select\n2")])
    with pytest.raises(ValueError):
        r.load_queries("select 1")


def test_byte_range_needs_one_of_each(spark):
    with pytest.raises(ValueError):
        r.byte_range(spark.range(1), "f", 0, 1)
