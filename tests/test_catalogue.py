"""Every query of the engine's own operators against its SQL on DuckDB, at the smallest scale."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from corvana.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    if name not in ORACLE:
        assert len(set(frame.columns)) == len(frame.columns)
        return
    other = duck.sql(ORACLE[name])
    assert sorted(other.columns) == columns
    order = [other.columns.index(c) for c in columns]
    theirs = [tuple(plain(row[k]) for k in order) for row in other.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)
