"""Every query with a SQL twin gives what DuckDB gives on the same tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from clickloom.plans.queries import ORACLE, QUERIES
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == normal(want.fetchall(), columns)
    assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
