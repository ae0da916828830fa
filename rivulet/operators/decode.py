"""Envelope and record decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rivulet.functions.payload import decode_payload, json_line, project_fields, split_objects
from rivulet.functions.times import parse_event_time

# Field names of the batch envelopes and of the records they carry.
STREAM_RECORD = T.StructType([
    T.StructField("kinesis", T.StructType([
        T.StructField("partitionKey", T.StringType()),
        T.StructField("kinesisSchemaVersion", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("sequenceNumber", T.StringType()),
        T.StructField("approximateArrivalTimestamp", T.DoubleType()),
    ])),
    T.StructField("eventSource", T.StringType()),
    T.StructField("eventID", T.StringType()),
    T.StructField("eventName", T.StringType()),
])
STREAM_ENVELOPE = T.StructType([T.StructField("Records", T.ArrayType(STREAM_RECORD))])

LOG_RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("timestampType", T.StringType()),
    T.StructField("value", T.StringType()),
])
LOG_ENVELOPE = T.StructType([
    T.StructField("eventSource", T.StringType()),
    T.StructField("records", T.MapType(T.StringType(), T.ArrayType(LOG_RECORD))),
])

# The typed records.
RIDE_REQUEST = T.StructType([
    T.StructField("trip_id", T.LongType()),
    T.StructField("ride_request_id", T.LongType()),
    T.StructField("vehicle_id", T.LongType()),
    T.StructField("expected_fare", T.DoubleType()),
])
TICK = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("price", T.DoubleType()),
])

BAD_JSON = "json"
BAD_BASE64 = "base64"
BAD_ENVELOPE = "envelope"


def parse_envelope(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Envelope JSON text to its typed columns, next to the other columns."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.from_json(column, schema).alias("__env")).select(*others, "__env.*")


def explode_stream_envelope(df: DataFrame, records: str = "Records") -> DataFrame:
    """One row per record of ``Records``, in envelope order, with its payload decoded.

    A record without data, or whose data is not base64, stays as a row with ``error_type`` set, and so
    does an envelope that cannot be read or holds no records (without a position).
    """
    others = [c for c in df.columns if c != records]
    rows = df.select(*others, F.posexplode_outer(records).alias("position", "__rec"))
    data = F.col("__rec.kinesis.data")
    payload = decode_payload(data)
    return rows.select(
        *others,
        "position",
        F.col("__rec.kinesis.partitionKey").alias("partition_key"),
        F.col("__rec.kinesis.sequenceNumber").alias("sequence_number"),
        payload.alias("payload"),
        F.when(F.col("position").isNull(), BAD_ENVELOPE).when(payload.isNull(), BAD_BASE64).alias("error_type"),
    )


def explode_log_envelope(df: DataFrame, records: str = "records") -> DataFrame:
    """One row per record of the ``topic-partition -> [record]`` map, with its payload decoded.

    An envelope that cannot be read or holds no records, and an empty list, stay as rows with
    ``error_type`` set and without a position.
    """
    others = [c for c in df.columns if c != records]
    lists = df.select(*others, F.explode_outer(records).alias("topic_partition", "__list"))
    rows = lists.select(*others, "topic_partition", F.posexplode_outer("__list").alias("position", "__rec"))
    payload = decode_payload(F.col("__rec.value"))
    return rows.select(
        *others,
        "topic_partition",
        "position",
        *[F.col(f"__rec.{name}").alias(name) for name in ("topic", "partition", "offset", "timestamp")],
        payload.alias("payload"),
        F.when(F.col("position").isNull(), BAD_ENVELOPE).when(payload.isNull(), BAD_BASE64).alias("error_type"),
    )


def consume_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Records processed per key, with the grand total as the row whose keys are null.

    Counted per key first, so the total is built from counts and not from a second copy of the rows.
    """
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count("payload").alias("decoded")
    )
    return counts.groupingSets([keys, []], *keys).agg(
        F.sum("records").alias("records"), F.sum("decoded").alias("decoded")
    )


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that later filters refer to instead of repeating its expression.

    Filters move below a projection and take a copy of what it computes; they stay above a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def decode_json(df: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Typed fields of a JSON column plus ``error_type``; unknown fields drop, missing ones are null."""
    others = [c for c in df.columns if c != column and c not in schema.names]
    marked = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    parsed = F.from_json(column, marked, {"columnNameOfCorruptRecord": "__corrupt"})
    bad = F.col("__p.__corrupt").isNotNull() | F.col("__p").isNull()
    return computed_once(df.select(*others, column), parsed, "__p").select(
        *others,
        *[F.when(~bad, F.col(f"__p.{name}")).alias(name) for name in schema.names],
        F.when(bad, BAD_JSON).alias("error_type"),
    )


def decode_ticks(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON ticks with ``event_time`` as a timestamp; unreadable time counts as a bad record."""
    rows = decode_json(df, TICK, column).withColumnRenamed("event_time", "__text")
    timed = computed_once(rows, parse_event_time(F.col("__text")), "event_time").drop("__text")
    bad = F.coalesce("error_type", F.when(F.col("event_time").isNull(), "event_time"))
    return timed.withColumn("error_type", bad)


def encode_json(df: DataFrame, columns: list[str], out: str = "value") -> DataFrame:
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, json_line(columns).alias(out))


def extract_keys(df: DataFrame, keys: dict[str, str], column: str = "value") -> DataFrame:
    """Add one column per field projection of the payload; an absent field is null."""
    parsed, fields = project_fields(F.col(column), keys, "__p")
    return computed_once(df, parsed, "__p").withColumns(fields).drop("__p")


def deaggregate(df: DataFrame, column: str = "value", out: str = "object") -> DataFrame:
    """One row per JSON object concatenated in the payload, with its position."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(split_objects(F.col(column))).alias("position", out))


def stream_envelopes(records: DataFrame, invocation: Column) -> DataFrame:
    """Gather records into batch envelopes. Each invocation must hold a bounded batch of records."""
    record = F.struct(
        F.struct(
            F.col("partition").cast("string").alias("partitionKey"),
            F.lit("1.0").alias("kinesisSchemaVersion"),
            F.col("value").alias("data"),
            F.lpad(F.col("offset").cast("string"), 20, "0").alias("sequenceNumber"),
            (F.col("timestamp") / 1000).alias("approximateArrivalTimestamp"),
        ).alias("kinesis"),
        F.col("topic").alias("eventSource"),
        F.concat_ws(":", "topic", F.col("offset").cast("string")).alias("eventID"),
        F.lit("record").alias("eventName"),
    )
    batch = F.sort_array(F.collect_list(F.struct("offset", record.alias("record"))))
    return records.groupBy(invocation.alias("invocation")).agg(batch.alias("__batch")).select(
        "invocation", F.col("__batch.record").alias("Records")
    )


def log_envelopes(records: DataFrame, invocation: Column) -> DataFrame:
    """Gather log records into ``topic-partition -> [record]`` envelopes of bounded batches."""
    # Both groupings are served by one shuffle on the invocation.
    placed = records.withColumn("invocation", invocation).repartition("invocation")
    by_partition = placed.groupBy(
        "invocation", F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("tp")
    ).agg(F.sort_array(F.collect_list(F.struct("offset", F.struct(*LOG_RECORD.names).alias("r")))).alias("__b"))
    return by_partition.groupBy("invocation").agg(
        F.map_from_entries(F.collect_list(F.struct("tp", F.col("__b.r")))).alias("records")
    )
