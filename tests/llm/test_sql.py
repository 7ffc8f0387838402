"""Queries that have SQL give what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from linkloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    said, df = c.sql(Q.oracle_sql()[name]), Q.queries()[name](spark, SF)
    assert sorted(said.columns) == sorted(df.columns)
    rows = [tuple(r[said.columns.index(x)] for x in df.columns) for r in said.fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in df.collect())
