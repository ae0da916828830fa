"""Session set-up and the shared folder that durable intermediate data lives in."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Building a plan is quicker without a stack trace per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "rivulet", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on in a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="rivulet-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for one run of one job."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def fixed_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A catalogue written in code as a table, kept in the plan itself and so free to broadcast."""
    names = [column.split()[0] for column in columns.split(",")]
    values = dict(zip(names, map(list, zip(*rows))))
    return spark.createDataFrame(pa.table(values), columns)
