"""Every query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quernstone.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return d


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(names, values):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in by] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    have, should = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(have) == len(should)
    assert have == should


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.queries().keys()
