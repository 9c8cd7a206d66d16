"""Every registered job against its SQL on the smallest tables."""

import pytest

from checks.catalog import QUERIES
from checks.compare import compare, duck
from checks.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_job_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_job_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name) == ""
