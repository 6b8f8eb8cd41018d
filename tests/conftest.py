import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lamina.session import build_session

    folder = tempfile.mkdtemp(prefix="lamina-tests-")
    session = build_session("tests", 8, **{"spark.sql.shuffle.partitions": 4, "spark.checkpoint.dir": f"file://{folder}", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
