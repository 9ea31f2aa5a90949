import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from panelwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
