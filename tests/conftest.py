import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spanlake.session import build_session

    scratch = tempfile.mkdtemp(prefix="spanlake-tests-")
    s = build_session(
        "local[4]",
        app_name="spanlake-tests",
        shuffle_partitions=8,
        extra={
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            "spark.local.dir": os.path.join(scratch, "local"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="spanlake-t-")
