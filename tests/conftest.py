import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lapak.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=4,
        **{"spark__ui__enabled": "false", "spark__driver__memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
