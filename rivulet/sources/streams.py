"""Reading streams, and the SQL table over one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rivulet.operators.decode import decode_ticks
from rivulet.operators.delivery import within

# Bounds on what one invocation takes (records, seconds) and the steady rate.
BATCH_RECORDS = (1, 10_000)
DEFAULT_BATCH_RECORDS = 100
BATCH_TIMEOUT_S = (1, 900)
STEADY_RATE = 100

# Hours a record is kept.
RETENTION_H = (24, 8760)

WATERMARK_DELAY = "5 seconds"

LATEST, EARLIEST = "latest", "earliest"


def admission(max_records: int = DEFAULT_BATCH_RECORDS) -> dict[str, str]:
    """Source options that admit at most so many records per micro-batch."""
    return {"maxOffsetsPerTrigger": str(int(within(max_records, BATCH_RECORDS, "batch size")))}


def rate_admission(interval_s: int, per_second: int = STEADY_RATE) -> dict[str, str]:
    """Source options and trigger interval that hold a steady rate."""
    within(interval_s, BATCH_TIMEOUT_S, "interval")
    return {"maxOffsetsPerTrigger": str(interval_s * per_second)}


def buffered(records: int, interval_s: int) -> dict[str, str]:
    """Source options for 'so many records or so long, whichever comes first'."""
    return {"minOffsetsPerTrigger": str(records), "maxTriggerDelay": f"{interval_s}s"}


def read_topic(
    spark: SparkSession, servers: str, topic: str, start: str = LATEST, options: dict[str, str] | None = None
) -> DataFrame:
    """A stream of log records from a Kafka topic; needs the Kafka connector on the class path."""
    if start not in (LATEST, EARLIEST):
        raise ValueError(f"start must be {LATEST!r} or {EARLIEST!r}")
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .options(**(options or {}))
    )
    return reader.load().withColumn("value", F.col("value").cast("string"))


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    start: str = EARLIEST,
    since: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """A stream over files arriving below ``path``. Starting at the latest position means records
    from the event time ``since`` on."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(path)
    if start == LATEST:
        if since is None:
            raise ValueError("a file stream needs 'since' to start at the latest position")
        rows = rows.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    return rows


def register_tick_table(spark: SparkSession, messages: DataFrame, name: str = "stock_table") -> DataFrame:
    """Bind JSON tick messages, batch or stream, to a SQL table with a watermark on event time.

    Messages that cannot be read are the rows of a second table, ``<name>_errors``.
    """
    rows = decode_ticks(messages)
    rows.where(F.col("error_type").isNotNull()).createOrReplaceTempView(f"{name}_errors")
    table = rows.where(F.col("error_type").isNull()).select(
        "ticker", "price", F.date_trunc("millisecond", "event_time").alias("event_time")
    ).withWatermark("event_time", WATERMARK_DELAY)
    table.createOrReplaceTempView(name)
    return table


def retain(df: DataFrame, ts: str, hours: int, now) -> DataFrame:
    """Records younger than the retention; ``now`` is a literal or a scalar subquery."""
    within(hours, RETENTION_H, "retention")
    return df.where(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))
