import pytest

import __spark_entry__ as entry_points
from verification import COVERS, ORACLES, QUERIES
from verification.check import compare, duck

from .conftest import SMALL

@pytest.mark.parametrize("name", tuple(ORACLES))
def test_query_equals_its_sql(spark, name):
    verdict, _, _ = compare(spark, duck(SMALL), QUERIES[name], ORACLES[name], SMALL)
    assert verdict.startswith("ok"), verdict


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())
    assert set(ORACLES) <= set(QUERIES)
    assert entry_points.queries().keys() >= QUERIES.keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 2
