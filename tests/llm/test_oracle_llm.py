"""Queries of the subpackage with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from tarifa.llm import registry
from tests.test_oracle import SF, TABLES, canonical


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect(config={"memory_limit": "5GB", "threads": 4})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle.execute(registry.ORACLE_SQL[name]).df()
    assert canonical(got) == canonical(want)
