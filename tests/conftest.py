"""One small Spark session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.executorEnv.PYTHONPATH", str(ROOT))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def column(spark):
    """Apply a column function to some texts."""
    from pyspark.sql import functions as F

    def apply(function, texts, kind="string"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
        return [r["x"] for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]

    return apply


@pytest.fixture
def lines_of(spark):
    """Rows (doc_id, line_idx, line) of some documents."""

    def build(*documents):
        rows = [(d, i, line) for d, lines in enumerate(documents) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "doc_id long, line_idx long, line string")

    return build
