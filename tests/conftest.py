import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clipweave.session import local_session

    s = local_session("4", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def rows(spark):
    """rows(df, cols) -> sorted list of tuples"""

    def get(df, *cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())

    return get
