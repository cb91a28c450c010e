import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.path.join(ROOT, "tests") + os.pathsep + os.path.join(ROOT, "tests", "llm") + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def segments(spark):
    """Makes segments from (start, end, text[, words]) of one media item."""
    from cuewise.schema import SEGMENT

    def make(*rows, media="m"):
        full = [(media, i, float(r[0]), float(r[1]), r[2], list(r[3]) if len(r) > 3 else []) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SEGMENT)

    return make


@pytest.fixture
def listed():
    """Rows of segments as (start, end, text), by media item and position."""

    def get(df):
        return [(r["start"], r["end"], r["text"]) for r in df.orderBy("media_id", "seg_idx").collect()]

    return get
