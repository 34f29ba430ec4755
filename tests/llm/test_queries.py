"""Queries of the subpackage against their SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from typelore.llm import queries

SF = "/root/testdata/sf0.01"


def test_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and queries.ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), connection.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda f: sorted(tuple(str(v)[:10] if "date" in str(type(v)).lower() or "time" in str(type(v)).lower() else v for v in r)
                               for r in f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), "").itertuples(index=False))
    assert as_rows(got) == as_rows(want)
