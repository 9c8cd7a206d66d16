import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crawlspark.session import configure  # noqa: E402

# columns are built at import time in the test modules, so the session comes first
SESSION = configure(
    SparkSession.builder.master("local[8]").appName("tests")
    .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def values(spark):
    """values(expression, inputs) → the expression over one-column rows, in order."""
    def run(expression, inputs, column="x"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {column} string")
        return [r.v for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]

    return run
