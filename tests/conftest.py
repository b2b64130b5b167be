import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from acctsig.session import local_session
    s = local_session("*", 8, app="acctsig-tests")
    yield s
    s.stop()
