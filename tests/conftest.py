"""One session for all tests, with few partitions."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

from quillgraph.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local(cpus=8, partitions=4, memory="6g")
    yield session
    session.stop()
