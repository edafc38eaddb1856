import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from mdforge.session import get_session

    s = get_session(4, shuffle_partitions=4, app="mdforge-tests")
    yield s
    s.stop()
