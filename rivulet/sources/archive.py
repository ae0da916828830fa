"""Reading delivered objects back, and replaying a slice of a partitioned data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rivulet.functions.payload import decode_payload
from rivulet.operators.decode import LOG_RECORD, decode_json

LOG_ORDER = ["topic", "partition", "offset"]


def read_archive(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """Archived log records with their decoded payload, in log order if wanted.

    The order is a range-partitioned sort: no task sees more than its share of a partition.
    """
    lines = spark.read.text(path).select("value").withColumnRenamed("value", "line")
    records = decode_json(lines, LOG_RECORD, "line")
    decoded = records.withColumn("payload", decode_payload(F.col("value")))
    return decoded.orderBy(*LOG_ORDER) if ordered else decoded


def replay(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    wanted: Column,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    within: str | None = None,
) -> DataFrame:
    """Stream the partitions of a historical data set that match the filter.

    Each micro-batch prunes its files by their partition values, so those of other partitions are listed but not
    read, whatever the values look like (null included), and partitions that come later are seen. ``within`` is a
    glob of folders below ``path``, such as ``dt=2024-01-*``, that bounds the listing of a long history; what lies
    outside is not part of the stream. Partition columns are those of the folders, typed by ``schema``.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("basePath", path)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(f"{path}/{within}" if within else path).where(wanted)
