"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from conftest import SF, rows_of, rows_of_sql
from korpusmill.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df) == rows_of_sql(duck, ORACLE_SQL[name])


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
