import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from typelore.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.log.level": "ERROR",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="typelore-tests-"),
    }
    session = build_session("tests", master="local[8]", shuffle_partitions=8, conf=conf)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
