import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def thin_slices(spark):
    """Make even small tables take the sliced paths."""
    keys = {"millrace.rowsPerSlice": "40", "millrace.percentileDistinctLimit": "3", "millrace.percentileRowLimit": "3"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)
