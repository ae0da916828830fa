"""Input tables and the stream-shaped tables derived from ``events``.

Each derived table is a row-wise projection (or one bounded grouping) of ``events``, so its size
follows the input and column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.functions.payload import encode_payload
from rivulet.functions.shards import shard_of
from rivulet.functions.times import epoch_millis

BROKERS = 3
SHARDS = 4
NAMESPACE = "rivulet/events"
TOPIC = "events"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def is_corrupt() -> Column:
    return F.col("event_id") % 97 == 0


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("ticker"),
        F.col("value").alias("price"),
    )


def tick_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as JSON text; odd ids carry the ISO-8601 time form, even ids the SQL one."""
    form = F.when(
        F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    ).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    body = F.to_json(
        F.struct(form.alias("event_time"), F.col("event_type").alias("ticker"), F.col("value").alias("price"))
    )
    return events(spark, sf_dir).select(
        "event_id", "ts", F.when(is_corrupt(), F.lit("{bad")).otherwise(body).alias("value")
    )


def ride_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ride_messages_of(events(spark, sf_dir))


def ride_messages_of(rows: DataFrame) -> DataFrame:
    """Ride requests as JSON text under the older schema: the id still travels as ``trip_id``."""
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("trip_id"),
            F.col("user_id").alias("vehicle_id"),
            F.col("event_type").alias("unknown_field"),
        )
    )
    return rows.select(
        "event_id",
        F.col("event_type").alias("type"),
        F.when(is_corrupt(), F.lit("{bad")).otherwise(body).alias("value"),
    )


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_records_of(events(spark, sf_dir))


def log_records_of(rows: DataFrame) -> DataFrame:
    """Log records with base64 values. The unique ``event_id`` is the offset: ascending within a
    partition and, as in a compacted log, not dense."""
    body = F.when(is_corrupt(), F.lit("{bad")).otherwise(F.col("props"))
    return rows.select(
        F.lit(TOPIC).alias("topic"),
        (F.col("user_id") % BROKERS).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        epoch_millis(F.col("ts")).alias("timestamp"),
        F.lit("CREATE_TIME").alias("timestampType"),
        encode_payload(body).alias("value"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric datapoints in long form with their dimensions in a map."""
    return events(spark, sf_dir).select(
        "ts",
        F.lit(NAMESPACE).alias("namespace"),
        F.col("event_type").alias("metric_name"),
        F.create_map(
            F.lit("stream"), F.col("event_type"),
            F.lit("broker"), (F.col("user_id") % BROKERS + 1).cast("string"),
            F.lit("shard"), shard_of(F.col("user_id"), SHARDS).cast("string"),
        ).alias("dims"),
        "value",
    )


def application_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of a running application, one per event."""
    by_type = {
        "view": F.concat(F.lit("Deploying task to flink-taskmanager-"), (F.col("user_id") % 7).cast("string")),
        "signup": F.concat(
            F.lit("Loading property: parallelism.default, "), (F.col("event_id") % 5).cast("string")
        ),
        "click": F.lit("AccessDenied while reading the source"),
        "purchase": F.lit("ResourceNotFoundException: no such sink"),
        "error": F.lit("Task switched from RUNNING to RESTARTING"),
    }
    message = F.lit(None).cast("string")
    for name, text in by_type.items():
        message = F.when(F.col("event_type") == name, text).otherwise(message)
    return events(spark, sf_dir).select(
        "event_id",
        "ts",
        message.alias("message"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("message_type"),
        F.concat(F.lit("application/app-"), (F.col("user_id") % 5).cast("string")).alias("application_arn"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an arrival time up to twenty minutes after the event, hence out of order."""
    return events(spark, sf_dir).select(
        "event_id",
        "ts",
        (F.col("user_id") % BROKERS).cast("int").alias("partition"),
        F.expr("ts + make_dt_interval(0, 0, 0, (event_id * 7919) % 1200)").alias("arrival"),
    )
