"""Every catalog query against its SQL in DuckDB, values and types."""

import duckdb
import pytest

from linkloom.plans import catalog, catalog_more, catalog_scale  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    found, expected = catalog.QUERIES[name](spark, SF), db.sql(catalog.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert {c: KINDS[k] for c, k in found.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(repr, expected.project(quoted).fetchall()))


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["external_destinations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pages_html_stays_out_of_shuffles(spark):
    plan = catalog.QUERIES["page_link_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "html" in line]
