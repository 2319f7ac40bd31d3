import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return s


@pytest.fixture
def events(spark):
    """Flow events from (src, dst, seconds, bytes) rows."""

    def make(rows, label="benign", scenario="s"):
        data = [
            (int(round(t * 1e6)), src, dst, 443, "tcp", "->", str(1000 + i % 7), size, label, scenario)
            for i, (src, dst, t, size) in enumerate(rows)
        ]
        return spark.createDataFrame(
            data,
            "t_us bigint, src_ip string, dst_ip string, dst_port int, protocol string, direction string, "
            "src_port string, size_bytes bigint, label string, scenario_name string",
        )

    return make
