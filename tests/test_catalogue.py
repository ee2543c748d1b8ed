"""Every query of the catalogue against its SQL, and the entry module."""

import pytest

import __spark_entry__ as entry
from tests.oracle import check
from tidewheel.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, catalogue.QUERIES[name], catalogue.SQL[name])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_gen_orders_is_seeded_and_in_range(spark, sf_dir):
    a, b = (catalogue.gen_orders(spark, sf_dir).orderBy("ts").collect() for _ in range(2))
    assert a == b and len(a) == 1000
    assert {r.productId for r in a} == {f"p{i}" for i in range(1, 6)} and {r.storeId for r in a} == set("ABC")
    assert all(1000 <= r.price <= 9999 and 1 <= r.qty <= 5 and r.normTs == r.ts and r.validated for r in a)


def test_aggregate_scans_two_columns_of_lineitem_and_pushes_filters(spark, sf_dir):
    plan = catalogue.lineitem_agg_final(spark, sf_dir)._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "partial_sum" in plan
    plan = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id > 10").select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,10)]" in plan
