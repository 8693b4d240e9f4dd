import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stratalens.session import local_session, tidy

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    tidy(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL
