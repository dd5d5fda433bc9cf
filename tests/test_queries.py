"""All queries with SQL against it on the smallest tables, and the shape of the contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(set(entry.catalog.QUERIES) & set(entry.oracle_sql()))


def plain(v):
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    got = entry.queries()[name](spark, small)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"create view {f.split('.')[0]} as from '{small}/{f}'")
    expected = con.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    want = sorted(tuple(map(plain, r)) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(columns).collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_of_input_does_not_matter(spark, small):
    from pyspark.sql import functions as F

    from attestra.operators import resolve
    from attestra.sources import bridge

    facts = bridge.facts(spark, small)
    a = resolve.first_facts(resolve.summary(facts)).agg(F.sum(F.xxhash64("bid_id", "field", "value").cast("decimal(38,0)"))).first()
    b = resolve.first_facts(resolve.summary(facts.repartition(7, "value"))).agg(F.sum(F.xxhash64("bid_id", "field", "value").cast("decimal(38,0)"))).first()
    assert a == b
