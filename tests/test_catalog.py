"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from flowtriage import fixtures
from flowtriage.catalog import ORACLES, QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=repr)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: DUCK_TYPES[t] for c, t in result.dtypes} == types
    order = [expected.columns.index(c) for c in columns]
    assert rows == sorted((tuple(row[i] for i in order) for row in expected.fetchall()), key=repr)


def test_driver_gets_every_query():
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLES.items() <= driver.oracle_sql().items()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_last_checkpoint_holds_every_call(spark, sf_dir):
    series = QUERIES["checkpoint_series"](spark, sf_dir).collect()
    stats = {r["model_name"]: r for r in QUERIES["call_stats"](spark, sf_dir).collect()}
    for row in series:
        if row["completed"] == max(r["completed"] for r in series):
            assert (row["calls"], row["errors"]) == (stats[row["model_name"]]["calls"], stats[row["model_name"]]["errors"])


ONE_PASS = [
    "ingest_csv", "typed_view", "read_jsonl_strict", "rule_flags", "tag_reasons", "suspects", "typed_suspects", "rules_by_label",
    "record_ids", "without_sensitive", "binary_label", "stratum_filter", "total_count", "label_distribution",
]


@pytest.fixture(scope="module")
def fresh(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("fresh"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ONE_PASS)
def test_one_pass_over_flows_stores_no_table(spark, sf_dir, fresh, name):
    fixtures.flows(spark, sf_dir)

    def rows(folder):
        return sorted((tuple(r) for r in QUERIES[name](spark, folder).collect()), key=repr)

    assert rows(fresh) == rows(sf_dir)
    assert (spark.sparkContext.applicationId, fresh) not in fixtures._STORED
