"""Sinks for streams of ticks and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.functions.times import DATE_PART, HOUR_PART
from rivulet.operators import delivery as d
from rivulet.operators.packing import MAX_RECORDS

# Least price that is kept, and the interval of exactly-once commits.
HOT_PRICE = 50
COMMIT_INTERVAL_S = 60

TICK_PARTITIONS = ["ticker", "dt", "hr"]
TIME_PARTITIONS = list(d.TIME_PREFIX)


def hot_ticks(ticks: DataFrame, least: float = HOT_PRICE) -> DataFrame:
    return ticks.where(F.col("price") > least)


def with_dt_hr(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({
        "dt": F.date_format("event_time", DATE_PART), "hr": F.date_format("event_time", HOUR_PART)
    })


def _trigger(seconds: int | None) -> dict:
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def sink_ticks(
    ticks: DataFrame,
    path: str,
    checkpoint: str,
    every_s: int | None = COMMIT_INTERVAL_S,
    writers: int | None = None,
    split: int = 1,
) -> StreamingQuery:
    """JSON files by (ticker, dt, hr), each record exactly once through the sink's commit log.

    Without an interval the query takes what is there and ends. Each micro-batch is dealt out over
    ``writers`` tasks (by default as many as the cluster has cores) by partition value, so a value has
    one file per micro-batch, whatever the order of the input. ``split`` spreads each value over that
    many tasks, for a ticker too hot for one.
    """
    writers = writers or ticks.sparkSession.sparkContext.defaultParallelism
    salt = F.pmod(F.xxhash64("event_time", "price"), F.lit(split))
    ticks = ticks.repartition(writers, *TICK_PARTITIONS, salt)
    return (
        ticks.writeStream.format("json")
        .partitionBy(*TICK_PARTITIONS)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every_s))
        .start(path)
    )


def read_ticks(spark, path: str) -> DataFrame:
    """What ``sink_ticks`` wrote; the schema keeps partition values as text."""
    schema = "event_time timestamp, price double, ticker string, dt string, hr string"
    return spark.read.schema(schema).json(path)


def console(df: DataFrame, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("console").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every_s: int | None
) -> StreamingQuery:
    def kept(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            write(batch, epoch)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(kept)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every_s))
        .start()
    )


def archive_sink(
    records: DataFrame,
    path: str,
    checkpoint: str,
    arrival: str = "arrival",
    line: str = "line",
    keys: list[str] | None = None,
    interval_s: int | None = d.DEFAULT_INTERVAL_S,
    buffer_mb: float = d.DEFAULT_BUFFER_MB,
    compression: str = "GZIP",
    delimiter: bool = True,
    time_parts: list[str] = TIME_PARTITIONS,
) -> StreamingQuery:
    """Buffered delivery of lines: flushed every interval, cut at the buffer size.

    Good rows go to ``data/[keys/]year=/month=/day=/hour=/``, rows with ``error_type`` or without one
    of the dynamic ``keys`` (or, without a delimiter, without a line) to
    ``errors/year=/month=/day=/hour=/error_type=/``, one a line. The last path level is
    the micro-batch, overwritten if that batch is repeated, so a restart leaves no duplicates. A
    coarser prefix takes fewer ``time_parts``.
    """
    d.codec(compression)
    if interval_s is not None:
        d.within(interval_s, d.INTERVAL_S, "buffer interval")
    d.within(buffer_mb, d.BUFFER_MB, "buffer size")
    keys = keys or []

    def write(batch: DataFrame, epoch: int) -> None:
        stamped = d.with_time_prefix(batch, arrival).withColumn("batch", F.lit(epoch))
        marked = d.mark_missing_keys(stamped, keys) if keys else stamped
        marked = marked if delimiter else d.mark_missing_lines(marked, line)
        if "error_type" in marked.columns:
            good, bad = d.route_errors(marked)
            d.write_objects(
                bad, f"{path}/errors", [*time_parts, "error_type", "batch"], line, buffer_mb,
                compression, mode="overwrite",
            )
        else:
            good = marked
        d.write_objects(
            good, f"{path}/data", [*keys, *time_parts, "batch"], line, buffer_mb, compression,
            delimiter, "overwrite",
        )

    return _each_batch(records, write, checkpoint, interval_s)


def dynamic_partition_sink(
    records: DataFrame, path: str, checkpoint: str, keys: list[str], **options
) -> StreamingQuery:
    """``archive_sink`` with extracted keys as leading path parts. Spark retries a failing batch."""
    return archive_sink(records, path, checkpoint, keys=keys, **options)


def dead_letter_sink(
    records: DataFrame,
    path: str,
    checkpoint: str,
    valid: Column,
    metadata: list[str],
    error: Column,
    every_s: int | None = None,
) -> StreamingQuery:
    """Valid rows to ``good``; for each other row its metadata and error to ``dead_letters``."""

    def write(batch: DataFrame, epoch: int) -> None:
        good, dead = d.with_dead_letter(batch, valid, metadata, error)
        for rows, name in ((good, "good"), (dead, "dead_letters")):
            stamped = rows.withColumn("batch", F.lit(epoch))
            writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch").parquet(f"{path}/{name}")

    return _each_batch(records, write, checkpoint, every_s)


def bisecting_sink(
    records: DataFrame,
    invocation: Column,
    order: list[str],
    make_process: Callable[[], d.Process],
    path: str,
    checkpoint: str,
    line: str = "line",
    every_s: int | None = None,
    retries: int = d.MAX_RETRIES,
    backoff: Callable[[], float] = d.random_backoff,
    max_records: int = MAX_RECORDS,
) -> StreamingQuery:
    """Hand the records of a stream to a processor in ordered batches; halve the batches it refuses.

    ``invocation`` numbers bounded groups of records, see ``packing.invocation_of``. Outcomes go to
    ``status=delivered`` and ``status=lost`` below ``path``: the latter are the dead letters, metadata
    (``order``), attempts and error of each record that failed by itself after its last retry, not its
    payload. A micro-batch that is repeated overwrites its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        sized = batch.withColumns({"invocation": invocation, "size": F.octet_length(line).cast("long")})
        outcomes = d.pack_and_process(
            sized, make_process, "invocation", order, order, line, max_records, retries=retries, backoff=backoff
        )
        writer = outcomes.withColumn("batch", F.lit(epoch)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").parquet(path)

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every_s))
        .start()
    )
