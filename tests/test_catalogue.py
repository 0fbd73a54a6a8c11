"""Every query against its SQL in DuckDB: names, rows and values."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from isolens import catalogue

DATA = Path("/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_query_has_an_answer_to_compare_with():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    got = catalogue.queries()[name](spark, str(DATA))
    want = duck.execute(catalogue.oracle_sql()[name])
    assert normal(got.columns, got.collect()) == normal([d[0] for d in want.description], want.fetchall())
