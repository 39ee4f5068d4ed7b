import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import local_session, release

    session = local_session("riskloom-tests", "8", "8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
