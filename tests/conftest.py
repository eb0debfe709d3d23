from __future__ import annotations

import pytest

from textquarry.session import local_session, steady


@pytest.fixture(scope="session")
def spark():
    session = steady(local_session(4, 4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
