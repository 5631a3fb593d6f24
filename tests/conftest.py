import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wattspark.session import get_session
    s = get_session("local[4]", app="wattspark-tests", shuffle_partitions=8)
    # tests run locally: a private checkpoint folder only where none is configured
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wattspark-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="wattspark-test-")


FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
