"""Every registered query that has SQL against DuckDB."""

import math

import duckdb
import pytest

from cubeflux.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    rows = sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr) == rows


def test_every_key_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 120
