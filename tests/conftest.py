import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftwork.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__ansi__enabled="true")
    yield s
    s.stop()
