"""Whole streaming jobs: from a stream of messages to tables and objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.operators import decode, delivery, enrich, packing
from rivulet.streaming.sinks import _each_batch

LOG_KEY = ["topic", "partition", "offset"]


def priced_rides(
    messages: DataFrame, make_client: Callable[[], enrich.Client] | None = None, kind: str | None = None
) -> DataFrame:
    """The ride job's rows: decode, keep one type, re-key, sample, price.

    Without a client the fare model runs as an expression. Rows that cannot be read or have no id are
    not priced and keep their ``error_type``; priced rows have none.
    """
    wanted = messages if kind is None else enrich.only_type(messages, F.col("type"), kind)
    keyed = enrich.with_request_id(decode.decode_json(wanted, decode.RIDE_REQUEST))
    sampled = enrich.sample_mod(keyed, "ride_request_id")
    if make_client is None:
        return enrich.price_natively(sampled)
    good, bad = delivery.route_errors(sampled)
    answered = enrich.apply_response(enrich.enrich(good, make_client))
    return answered.withColumn("error_type", F.lit(None).cast("string")).unionByName(bad)


def ride_job(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    make_client: Callable[[], enrich.Client] | None = None,
    kind: str | None = None,
    every_s: int | None = None,
) -> StreamingQuery:
    """Priced rides of a stream, and its unreadable requests with their ``error_type``, as Parquet
    files, each once through the sink's commit log."""
    trigger = {"availableNow": True} if every_s is None else {"processingTime": f"{every_s} seconds"}
    return (
        priced_rides(messages, make_client, kind)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def delivery_job(
    records: DataFrame,
    invocation: Column,
    make_client: Callable[[], delivery.PutClient],
    path: str,
    checkpoint: str,
    every_s: int | None = None,
    backoff: Callable[[], float] = delivery.random_backoff,
) -> StreamingQuery:
    """Put the log records of a stream in batches and keep one outcome row per record.

    ``invocation`` numbers bounded groups of records, see ``packing.invocation_of``. Outcomes go to
    ``outcomes/batch=N``, where lost and oversize records keep their line, ready to be sent again.
    """
    columns = decode.LOG_RECORD.names

    def write(batch: DataFrame, epoch: int) -> None:
        lines = packing.to_lines(batch, columns, LOG_KEY).withColumn("invocation", invocation)
        fits, oversize = packing.split_oversize(lines)
        sent = delivery.pack_and_deliver(
            fits, make_client, "invocation", LOG_KEY, [*LOG_KEY, "line"], backoff=backoff
        )
        outcomes = sent.withColumn("line", F.when(F.col("status") == delivery.LOST, F.col("line")))
        refused = oversize.select(
            "invocation",
            F.lit(None).cast("bigint").alias("batch_no"),
            *LOG_KEY,
            "line",
            F.lit(0).alias("attempts"),
            F.lit(delivery.LOST).alias("status"),
            F.col("error_type").alias("error"),
        )
        # Written in one action: reading the outcomes twice would put the records twice.
        outcomes.unionByName(refused).write.mode("overwrite").parquet(f"{path}/outcomes/batch={epoch}")

    return _each_batch(records, write, checkpoint, every_s)
