import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from crosscheck import session

    s = session()
    yield s
    s.stop()


@pytest.fixture
def ts():
    from datetime import datetime

    return datetime.fromisoformat
