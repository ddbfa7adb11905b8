"""Training-data queries that have an SQL twin give what DuckDB gives."""

import os

import duckdb
import pytest

from framelake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    theirs = con.execute(ORACLE_SQL[name]).df()
    ours = QUERIES[name](spark, data).toPandas()[list(theirs.columns)]
    assert sorted(map(tuple, ours.astype(str).to_numpy())) == sorted(map(tuple, theirs.astype(str).to_numpy()))
