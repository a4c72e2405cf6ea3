import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from voxframe.session import get_spark

    session = get_spark("tests", 8, 4)
    yield session
    session.stop()
