import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventtally.plans.ingest import Stores  # noqa: E402
from eventtally.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    # A zone with summer time, so that any reliance on the session zone shows.
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__sql__session__timeZone="America/New_York",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def stores(spark, tmp_path):
    return Stores(spark, str(tmp_path / "deployment"))
