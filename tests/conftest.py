import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from drivegrid.session import build_session

    s = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
