import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def chat(spark):
    """Messages of one chat from (user, message) pairs, one minute apart."""

    def build(*lines, chat_id="c"):
        rows = [(chat_id, i, user, text) for i, (user, text) in enumerate(lines, 1)]
        return spark.createDataFrame(
            rows, "chat_id string, message_id long, user string, message string"
        ).selectExpr(
            "*", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, message_id) AS date"
        )

    return build
