"""Registered queries against their SQL counterpart on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as contract  # noqa: E402
from docquarry.plans.oracle import ORACLE  # noqa: E402
from docquarry.plans.queries import REGISTRY  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def rows(records):
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in record) for record in records)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.queries())
    assert set(REGISTRY) - set(ORACLE) == {"stemmed_search", "highlights"}


@needs_tables
def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "rank", "chunk_id", "score"]


@needs_tables
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sql, name):
    frame = contract.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    found = rows(frame.select(*columns).collect())
    if name not in contract.oracle_sql():
        assert found
        return
    result = sql.execute(contract.oracle_sql()[name])
    order = [column[0] for column in result.description]
    assert sorted(order) == columns
    places = [order.index(column) for column in columns]
    assert found == rows(tuple(record[i] for i in places) for record in result.fetchall())
