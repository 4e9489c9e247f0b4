import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from postmill.session import build_session

    session = build_session(
        "tests", 8, spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Evaluate a Column over a list of input tuples; one result per tuple."""

    def run(schema, data, column):
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], f"_i long, {schema}")
        return [r["out"] for r in frame.select("_i", column.alias("out")).orderBy("_i").collect()]

    return run
