"""Every registered query that SQL can state, against SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, duck, name):
    ok, message = oracle.compare(spark, duck, name, driver.queries()[name], driver.oracle_sql()[name], FOLDER)
    assert ok, message
