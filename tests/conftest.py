import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="scrubspark-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("scrubspark-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def people(spark):
    """The unit-test table: one row per defect the reference's examples show."""
    schema = ("customer_id BIGINT, full_name STRING, age DOUBLE, salary STRING, price STRING, city STRING, "
              "state STRING, signup_date STRING, score_txt STRING, status STRING")
    rows = [
        (1, "Ada Lovelace", 36.0, "52000", "9.99", "Mumbai", "NY", "2020-01-15", "10", "active"),
        (2, "alan turing", None, "61000.5", "abc", " mumbai ", "New York", "2021-06-30 10:20:30", "forty", "active"),
        (3, "Grace Hopper", 85.0, None, "12", "MUMBAI", "CA", "not a date", "7.5", "inactive"),
        (4, "o'neil 3rd", 160.0, "1e400", None, "Pune", "NY", None, None, None),
        (5, "Linus", 28.0, " 42 ", "1d", " Delhi ", "TX", "03/04/2022", "1e3", "active"),
        (1, "Ada Lovelace", 36.0, "52000", "9.99", "Mumbai", "NY", "2020-01-15", "10", "active"),
        (6, "Edsger Dijkstra", 72.0, "70000", "5", "delhi", "ny", "2019-12-31", "-3", "pending"),
        (7, "Barbara Liskov", None, "", "7", "Pune", "CA", "12:00", "inf", "active"),
    ]
    return spark.createDataFrame(rows, schema)
