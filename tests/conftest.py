import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Workers of the tests import the package too.
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import build

    s = build("tests", 4, spark__sql__shuffle__partitions="4")
    s.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    return s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL
