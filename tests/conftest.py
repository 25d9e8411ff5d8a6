import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from lodestone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", 4, **{"spark.driver.memory": "4g", "spark.sql.ansi.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
