import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from wirelens.session import local_session

    # tiny inputs: planning dominates, so skip the runtime re-planning the benches and jobs use
    session = local_session(8, "tests", **{"spark.sql.adaptive.enabled": "false",
                                           "spark.sql.shuffle.partitions": "3"})
    yield session
    session.stop()
