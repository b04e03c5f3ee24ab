"""Every registered query on the smallest tables: the answer of its SQL, and a plan without joins of everything."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from triagemill.workload import registry

REPO = Path(__file__).resolve().parents[1]
SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return v

    return sorted(([cell(v) for v in row] for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "RoundRobinPartitioning" not in plan
    columns = sorted(df.columns)
    rows = comparable(df.select(*columns).collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == comparable([[r[i] for i in order] for r in result.fetchall()])


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["triagemill.llm", "corpus_pipeline", "sentencepiece", "zstandard", "xxhash"])
def test_without_the_corpus_operators_or_what_they_import(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
        "assert len(e.queries()) > 80 and set(e.oracle_sql()) == set(e.queries()) and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(REPO), timeout=100)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())
