import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chainframe.session import get_spark

    s = get_spark("local[*]", 8, app="chainframe-tests", extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
