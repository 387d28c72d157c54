import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def one(spark):
    """Evaluate a column over literal rows: one(column, a=[..], b=[..]) -> list."""
    def run(column, schema=None, **values):
        names = list(values)
        rows = [(i, *row) for i, row in enumerate(zip(*values.values()))]
        kinds = schema or ", ".join(f"{n} string" for n in names)
        return [r["out"] for r in spark.createDataFrame(rows, f"_n int, {kinds}").select("_n", column.alias("out")).orderBy("_n").collect()]

    return run
