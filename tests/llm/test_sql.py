"""The SQL of the queries on the smallest tables."""

import duckdb
import pytest

from triagemill.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = connection.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    order = [[c[0] for c in result.description].index(c) for c in columns]
    df = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == columns
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    assert got == sorted(([r[i] for i in order] for r in result.fetchall()), key=repr)
