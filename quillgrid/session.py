"""Session helpers: settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "quillgrid", **conf: str) -> SparkSession:
    """A session with the settings the plans expect; extra settings override them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master.startswith("local"):
        settings["spark.driver.memory"] = "8g"
    settings.update(conf)
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings results depend on: the last of duplicate keys wins, in JSON and in maps."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``, and must. Only a local session, whose tasks share the
    driver's disk, gets a temporary folder where that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, used by one run only."""
    return f"{work_dir(spark)}/quillgrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives the planner the true size: it then
    broadcasts the table if it is below Spark's own threshold and shuffles it otherwise.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
