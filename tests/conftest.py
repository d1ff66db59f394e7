import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shopgroups.session import build_session
    s = build_session("local[4]", 4)
    # tests only: no cluster-provided checkpoint folder here
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shopgroups-test-ckpt-"))
    yield s
    s.stop()
