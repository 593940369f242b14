import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from vigilspark.session import local_session

    session = local_session(
        "tests", 8, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-", dir="/tmp")
    )
    yield session
    session.stop()
