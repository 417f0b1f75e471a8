import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from tabstudy.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8)


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def many_ranges(spark):
    """Cut running totals and codes into many small ranges, as large inputs are."""
    spark.conf.set("tabstudy.rowsPerRange", "50")
    yield
    spark.conf.unset("tabstudy.rowsPerRange")
