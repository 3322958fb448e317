"""Every query of the delivery log against its SQL in DuckDB, value by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from loomline.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, "nan" if isinstance(v, float) and math.isnan(v) else float(v))
    return (3, str(v))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(key(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(key(r[i]) for i in at) for r in relation.fetchall())
