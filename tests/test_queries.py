"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from check import compare, connect
from millrace.queries import ORACLES, QUERIES

FOLDER = os.environ.get("MILLRACE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    assert compare(df, con, ORACLES[key]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
