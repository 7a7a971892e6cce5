import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Apply a function of one string column to Python strings; all answers in one job."""

    def run(function, texts):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        found = rows.select("i", function(F.col("t")).alias("r")).collect()
        return [row["r"] for row in sorted(found, key=lambda row: row["i"])]

    return run


@pytest.fixture(scope="session")
def pages(spark):
    def make(*htmls, url="https://www.amazon.com/dp/B000000001"):
        rows = [(i, url, html) for i, html in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return make
