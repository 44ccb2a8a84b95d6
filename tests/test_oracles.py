"""Every query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest
from curricle import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that find nothing in the smallest tables.
NONE_IN_SMALL_DATA: set[str] = set()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        path = Path(data, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def compare(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(cell(r[relation.columns.index(n)]) for n in names) for r in relation.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
    return len(ours)


#: Queries that SQL can't express, which are tested against plain versions.
NOT_SQL = {"match_sequential"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - NOT_SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    assert name in catalogue.ORACLES
    assert compare(df, duck.sql(catalogue.ORACLES[name])) > 0 or name in NONE_IN_SMALL_DATA
