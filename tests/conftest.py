import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lokora.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tests are many tiny jobs: compile quickly rather than well.
    session = local_session("4", "lokora-tests", 3, "-XX:TieredStopAtLevel=1")
    yield session
    session.stop()
