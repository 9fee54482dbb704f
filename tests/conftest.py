import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session(int(os.environ.get("TEST_CPUS", "4")))
    yield s
    s.stop()


@pytest.fixture()
def lines_of(spark):
    """Raw text to a table of lines of one source."""

    def make(text, source="s"):
        rows = [(source, i, line) for i, line in enumerate(text.split("\n"))]
        return spark.createDataFrame(rows, "source_id string, line_no long, payload string")

    return make
