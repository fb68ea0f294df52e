"""One local session for all tests."""

from __future__ import annotations

import faulthandler
import os
import signal
import sys
from pathlib import Path

import pytest

#: Seconds that a test may take, its fixtures included.
LIMIT = int(os.environ.get("TEST_LIMIT", "600"))

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.hookimpl(wrapper=True)
def pytest_runtest_protocol(item, nextitem):
    """A test that takes too long fails, and the others go on; one that doesn't even heed the alarm ends the run, with its place."""

    def late(*_):
        raise TimeoutError(f"{item.nodeid} took more than {LIMIT} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LIMIT)
    faulthandler.dump_traceback_later(LIMIT + 60, exit=True)
    try:
        return (yield)
    finally:
        signal.alarm(0)
        faulthandler.cancel_dump_traceback_later()
        signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
