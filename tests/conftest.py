import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gyratory.session import GROUP_ROWS_CONF, build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", 8)
    yield session


@pytest.fixture(params=["plain", "tiled"])
def both_paths(request, spark):
    """Run a test with the plain window and again with keys cut into tiles."""
    if request.param == "tiled":
        spark.conf.set(GROUP_ROWS_CONF, "3")
    yield request.param
    spark.conf.unset(GROUP_ROWS_CONF)
