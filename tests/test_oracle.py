"""Every registered query of the library proper against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from docvigil import plans
from docvigil.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    wanted = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
