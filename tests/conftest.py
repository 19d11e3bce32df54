import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from gradus.session import local_session

    s = local_session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
