import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quire.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("quire-tests", 4, 4, "4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
