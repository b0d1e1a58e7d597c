"""The queries of this subpackage that have SQL against it, at the smallest scale."""

import os

import duckdb
import pytest

from corvana.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame, other = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    assert frame.columns == other.columns
    mine, theirs = ([tuple(r) for r in rows] for rows in (frame.collect(), other.fetchall()))
    assert len(mine) > 50 and sorted(mine, key=repr) == sorted(theirs, key=repr)
