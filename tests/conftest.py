import os

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gleanwork.session import get_session

    session = get_session("tests", "4")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
