import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomspace.plans.runtime import ship, spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session("local[4]", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
