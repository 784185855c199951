import pytest
from pyspark.sql import functions as F

from binframe.functions.expr import ExpressionError, Lowering, parse, value_of
from binframe.functions.types import cast
from binframe.operators import projection as p


def evaluate(spark, text, **row):
    df = spark.createDataFrame([(row,)], "_ struct<a:bigint,b:double,s:string,x:binary,t:boolean,camelCase:bigint,l:array<int>>")
    low = Lowering({"_": value_of(F.col("_"), df.schema["_"].dataType)}, [F.lit(5)])
    return df.select(low(text).column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [
    ("_.a + 1", 8), ("_.a / 2", 3.5), ("_.a / 0", None), ("_.a % 0", None), ("-7 % 3", -1), ("_.s + 1", "hi1"), ("1.0 + _.s", "1hi"), ("_.a == 7", True), ("_.a == 'x'", False), ("_.missing == 1", None), ("_.missing + 1", None),
    ("not _.missing", True), ("_.a and _.b", 0.5), ("0 or _.a", 7), ("_.missing or 3", 3), ("_.t ? 1 : 2", 2), ("1 << 31", -(1 << 31)), ("-1 >>> 0", 0xFFFFFFFF), ("~0", -1), ("5 & 6 | 8 ^ 1", 13), ("0x10", 16), ("_.camel_case", 3),
    ("len(_.s)", 2), ("len(_.x)", 3), ("len(_.l)", 2), ("u24be(_.x)", 66051), ("ip4_str(_.x)", None), ("enum_str(_.a)", "7"), ("to_i('12')", 12.0), ("to_i('x')", None), ("_index(0)", 5), ("_index(1)", None), ("dos_dttm(0x52CF63D6)", 1623760244000000), ("dos_dttm(0)", None), ("1 < 2 and 2 < 1", False), ("2 + 3 * 4 - -1", 15),
])
def test_values(spark, text, want):
    assert evaluate(spark, text, a=7, b=0.5, s="hi", x=b"\1\2\3", t=False, camelCase=3, l=[1, 2]) == want


@pytest.mark.parametrize("text,code", [("1 +", "EXPRESSION_SYNTAX"), ("a[0]", "EXPRESSION_SYNTAX"), ("f(1)", "EXPRESSION_UNKNOWN_FUNCTION"), ("len(1, 2)", "EXPRESSION_SYNTAX"), ("len(1 2)", "EXPRESSION_ARITY"), ("(1", "EXPRESSION_SYNTAX")])
def test_mistakes_have_codes(text, code):
    with pytest.raises(ExpressionError) as e:
        parse(text)
    assert e.value.code == code


def test_unknown_names(spark):
    with pytest.raises(ExpressionError):
        Lowering({})("x")


def test_casts_wrap(spark):
    df = spark.range(1).select(cast(F.lit(300), "int8").alias("a"), cast(F.lit(-1), "uint16").alias("b"), cast(F.lit(2.9), "int32").alias("c"), cast(F.lit(128), "int8").alias("d"), cast(F.lit(1), "timestamp_us").cast("string").alias("e"))
    assert tuple(df.first()) == (44, 65535, 2, -128, "1970-01-01 00:00:00.000001")


@pytest.mark.parametrize("spec,code", [
    ({"version": "0.2"}, "UNSUPPORTED_VERSION"), ({"tables": [{"name": "errors", "rows": "$"}]}, "RESERVED_TABLE"), ({"tables": [{"name": "a", "rows": "x"}]}, "ANCHOR_SYNTAX"), ({"tables": [{"name": "a", "rows": "$"}, {"name": "A", "rows": "$"}]}, "DUPLICATE_TABLE"),
    ({"tables": [{"name": "a", "rows": "$", "columns": [{"name": "_src_start", "type": "int8", "expr": "1"}]}]}, "RESERVED_COLUMN"), ({"tables": [{"name": "a", "rows": "$", "columns": [{"name": "c", "type": "float", "expr": "1"}]}]}, "UNKNOWN_TYPE"),
    ({"tables": [{"name": "a", "rows": "$.x", "state": [{"name": "s", "scope": "$.y", "init": "0", "update": "s"}]}]}, "STATE_SCOPE"),
])
def test_specifications_are_checked(spec, code):
    with pytest.raises(p.ProjectionError) as e:
        p.compile_spec(spec)
    assert e.value.code == code


def test_nested_anchor(spark):
    df = spark.createDataFrame([("f", 0, {"a": [{"b": [1, 2]}, {"b": []}, {"b": [3]}]})], "_src_file string, ordinal long, root struct<a:array<struct<b:array<int>>>>")
    (t,) = p.compile_spec({"tables": [{"name": "t", "rows": "$.a[*].b[*]", "key": "k", "columns": [{"name": "v", "type": "int32", "expr": "_"}, {"name": "i", "type": "int8", "expr": "_index(0)"}, {"name": "j", "type": "int8", "expr": "_index(1)"}]}]})
    assert [tuple(r)[:4] for r in p.project(df, t).orderBy("k").collect()] == [(1, 1, 0, 0), (2, 2, 0, 1), (3, 3, 2, 0)]
