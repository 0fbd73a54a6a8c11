"""The SQL of the queries that have one, in DuckDB over the same tables."""

import duckdb
import pytest

from isolens.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = queries.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)
