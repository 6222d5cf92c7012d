"""The queries that SQL can express, against DuckDB."""

import os

import pytest

from tallywright.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cursor = c.execute(SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    told = lambda rows, names: sorted(repr([r[names.index(n)] for n in sorted(names)]) for r in rows)
    assert told([tuple(r) for r in df.collect()], df.columns) == told(cursor.fetchall(), columns)
