import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mergescope.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"
# Column expressions in test parameters need a session while tests are collected.
SESSION = build_session(shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
