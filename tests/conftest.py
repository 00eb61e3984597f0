"""One small local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlark.session import session

    extra = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    s = session("tests", "local[4]", **extra)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Reader of a driver table at the smallest size; skips where it is absent."""

    def read(name, sf="sf0.001"):
        path = f"/root/testdata/{sf}/{name}.parquet"
        if not os.path.exists(path):
            pytest.skip(f"no {path}")
        return spark.read.parquet(path)

    return read
