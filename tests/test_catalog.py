"""Every registered query against its SQL on the smallest scale."""

import pytest

import check
from parley.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    verdict, _ = check.compare(spark, con, name, SF)
    assert not verdict.startswith("FAIL"), verdict


def test_names_and_sql_belong_together():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
