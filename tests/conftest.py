import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import verify  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = verify.session("8")
    # Small frames: fewer tasks make the suite faster and change no result.
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
