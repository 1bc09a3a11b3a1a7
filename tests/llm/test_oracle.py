"""Queries with SQL twins give what DuckDB gives on whole tables."""

import pytest

from clickloom.llm.queries import oracle_sql, queries
from tests.test_oracle import SF, db, normal  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, db, name):  # noqa: F811
    df = queries()[name](spark, SF)
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)
