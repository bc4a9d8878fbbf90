from __future__ import annotations

import os

import pytest

from ledgermill.session import get_spark

TESTDATA = os.environ.get("LEDGERMILL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "ledgermill-tests",
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir() -> str:
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def oracle_dir() -> str:
    return f"{TESTDATA}/sf0.01"
