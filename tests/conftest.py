import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rookery.session import build_session
    ckpt = tempfile.mkdtemp(prefix="rookery-test-ckpt-")
    s = build_session("local[8]", app_name="rookery-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from rookery.plans.verify import duckdb_connection
    return duckdb_connection(SF01)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="rookery-test-")
