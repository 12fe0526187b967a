import math
import os

import duckdb
import pytest

from volatide.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(expected.columns)
    a, b = rows_of(found.columns, found.collect()), rows_of(expected.columns, expected.fetchall())
    assert len(a) == len(b)
    assert a == b
