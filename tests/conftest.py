import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from triagemill.plans.staging import release  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """A zone with daylight saving, so that any leak of the session zone into NTZ arithmetic shows."""
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def lines(spark):
    """Log lines to a frame, in order, by file."""

    def make(*texts, source_file="a.log"):
        rows = [(source_file, i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "source_file string, seq long, value string")

    return make
