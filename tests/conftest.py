import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from revlens.session import checkpoint_dir, get_session
    s = get_session("local[4]", 8, app_name="revlens-tests")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # tests have no cluster folder: a scratch one is registered
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="revlens-test-", dir="/tmp")
