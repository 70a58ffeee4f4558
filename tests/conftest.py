import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.paths import SF, SF01  # noqa: E402,F401  (other modules import them from here, too)


@pytest.fixture(scope="session")
def spark():
    from tabsense.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
