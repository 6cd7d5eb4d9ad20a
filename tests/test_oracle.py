"""Every registered query with SQL gives in Spark what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from resonara.plans.registry import NAMES, ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def rows_of(pdf):
    return sorted(repr([plain(v) for v in r]) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLE_SQL])
def test_equals_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)


def test_every_query_but_two_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"separate_stems", "split_stem"}
