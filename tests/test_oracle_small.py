"""Every registered query against its DuckDB statement at sf0.001 (row count + values)."""

import duckdb
import pytest

from conftest import SF0001

import __spark_entry__ as E

TABLES = ["documents", "embeddings", "pages", "benchmark"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def _norm(rows):
    return sorted(tuple(str(v) if v is not None else None for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    rows = df.select(*ocols).collect()
    assert _norm(rows) == _norm(orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 88
    assert df.columns == ["target_path", "action", "match_path", "match_type", "distance_or_hash", "reason"]
