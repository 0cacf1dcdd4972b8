import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quillgrid.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="quillgrid-tests-")
    session = build_session(
        **{
            "spark.checkpoint.dir": work,
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": os.path.join(work, "warehouse"),
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def column(spark):
    """Evaluate a column function over a list of texts."""

    def run(fn, values, schema="v string"):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, " + schema)
        out = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return run
