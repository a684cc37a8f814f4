"""Every query of the registry with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from tarifa import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is pd.NA or v is None or v != v:
            return "null"
        return f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ in ("Decimal", "int64", "int32", "float64") else str(v)

    return sorted(tuple(map(value, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    assert canonical(registry.QUERIES[name](spark, SF).toPandas()) == canonical(oracle.execute(registry.ORACLE_SQL[name]).df())
