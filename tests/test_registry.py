"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from typelore.plans import oracle as oracle_module
from typelore.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "documents", "embeddings", "conversations")

QUERIES, ORACLE = registry.QUERIES, oracle_module.ORACLE


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if frame[column].dtype.kind == "f":
            frame[column] = frame[column].round(6) + 0.0
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(repr(tuple(row)) for row in frame.itertuples(index=False))


def test_only_projections_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"project_2d", "plot_table"}
    assert set(ORACLE) <= set(QUERIES) <= set(contract.queries())
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        want = oracle.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    assert contract.entry(spark).columns == ["mbti_type", "users"]
