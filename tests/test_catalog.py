"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest
from crosscheck import ROOT, compare

from memspark import catalog

SF = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    rows, _, _, problems = compare(spark, name, SF)
    assert not problems
    assert rows > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
