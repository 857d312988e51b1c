import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vacantia.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
