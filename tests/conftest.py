"""One small session for all tests."""

import pytest

from casewright.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "casewright-tests", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
