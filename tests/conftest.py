import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracewise.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="tracewise-tests",
                      extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
