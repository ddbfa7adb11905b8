"""Every query with an SQL twin gives what DuckDB gives, on whole tables."""

import math
import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framelake.plans import registry  # noqa: E402

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def canonical(frame, columns):
    show = lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v.item() if hasattr(v, "item") else v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert canonical(ours.astype(object), columns) == canonical(theirs.astype(object), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    got = QUERIES[name](spark, data)
    rows = got.collect()
    assert rows and all(len(r) == len(got.columns) for r in rows) and len(set(map(str, rows))) == len(rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
