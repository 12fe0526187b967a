import math
import os

import duckdb
import pytest

from volatide.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows]
    return sorted(flat, key=repr)


def kind(x):
    return {"int": "int", "bigint": "int", "hugeint": "huge"}.get(str(x).lower(), str(x).lower())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, con, name):
    expected = con.sql(catalogue.ORACLES[name])
    found = catalogue.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(expected.columns)
    assert not [c for c, t in zip(expected.columns, expected.types, strict=True) if "HUGEINT" in str(t)]
    a, b = rows_of(found.columns, found.collect()), rows_of(expected.columns, expected.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]
