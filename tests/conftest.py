import pytest

from tidewatch.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL
