import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quire.session import open_session

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = open_session("tests", 4, spark__sql__shuffle__partitions="4", spark__local__dir=folder, spark__sql__warehouse__dir=f"{folder}/warehouse", spark__ui__showConsoleProgress="false", spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    return DATA
