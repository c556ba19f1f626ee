import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
