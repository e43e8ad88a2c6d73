import pytest

from marketloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
