import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from ledgerlane.session import local_session  # noqa: E402
from ledgerlane.sources.views import Lending  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lending(spark):
    return Lending(spark, SMALL)
