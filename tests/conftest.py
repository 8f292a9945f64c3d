from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from encaudit.session import clear_settled


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("encaudit-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="encaudit-tests-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_settled(session)
    session.stop()


@pytest.fixture
def make_files(spark):
    """DataFrame of (path, content, label) from a list of such rows."""

    def make(rows):
        table = spark.createDataFrame(
            [(path, bytearray(content), label) for path, content, label in rows],
            "path string, content binary, label string",
        )
        return table.selectExpr("path", "octet_length(content) * 1L AS length", "content", "label")

    return make
