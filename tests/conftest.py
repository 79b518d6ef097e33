import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from areagrade.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_sql_ui_retainedExecutions="20000",  # tests that count scans look up plans by their number
        spark_driver_memory="4g",
        spark_checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Build a small frame: frame("a string, n int", ("x", 1), ("y", 2))."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="session")
def one(frame):
    """Apply a column function to text values: one(values, function, *arguments) -> list."""

    def evaluate(values, function, *arguments):
        df = frame("i int, t string", *enumerate(values))
        return [row[0] for row in df.orderBy("i").select(function(df["t"], *arguments)).collect()]

    return evaluate


def tuples(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
