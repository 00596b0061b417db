import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_units(spark):
    """Units from (path, content) rows, or (repo, path, commit, day, content)."""
    from pyspark.sql import functions as F

    def make(*rows):
        full = [
            r if len(r) == 5 else ("repo", r[0], "c1", 1, r[1]) for r in rows
        ]
        frame = spark.createDataFrame(
            full, "repo_id string, path string, commit_id string, day int, content string"
        )
        return frame.select(
            "repo_id", "path", "commit_id", F.lit("dev").alias("author"),
            F.timestamp_seconds(F.lit(1767225600) + (F.col("day") - 1) * 86400).alias("ts"),
            "content",
        )

    return make
