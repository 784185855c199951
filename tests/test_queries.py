import pytest

import __spark_entry__ as entry
from binframe.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_its_sql(spark, name):
    assert compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scan_is_pruned_and_filtered(spark, capsys):
    catalog.queries()["scan_filter_project"](spark, "/root/testdata/sf0.001").explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThan(l_quantity,45.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate" in text
