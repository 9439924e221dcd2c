import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chartloom.session import build_session

    session = build_session(
        "chartloom-tests", master="local[*]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions on a single row."""

    def run(*columns):
        return spark.range(1).select(*columns).first()

    return run
