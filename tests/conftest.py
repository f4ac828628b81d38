import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from keelson.session import session

    s = session("tests", cores=8, shuffle=8, **{"spark.driver.memory": "6g", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Order-insensitive comparison of a DataFrame with rows."""

    def check(df, rows):
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        assert got == sorted((tuple(r) for r in rows), key=repr)

    return check
