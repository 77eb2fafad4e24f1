import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from starloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate an expression over a single value."""

    def evaluate(build, value, kind="string"):
        frame = spark.createDataFrame([(value,)], f"v {kind}")
        return frame.select(build(frame["v"]).alias("r")).first()["r"]

    return evaluate
