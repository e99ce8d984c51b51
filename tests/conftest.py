import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from txflow.session import get_session  # noqa: E402
from txflow.streaming.verdicts import enable_state  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[8]", 4, spark__ui__enabled="false", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    enable_state(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
