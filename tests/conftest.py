import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from chalkline.session import build_session
    # the session's spark.checkpoint.dir is used when set; build_session creates a
    # scratch folder only when it is unset (local mode only)
    s = build_session("local[8]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
