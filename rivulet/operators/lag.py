"""Lateness and consumer lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivulet.functions.times import epoch_millis, period_start
from rivulet.operators.ordered import running_max_before, same_keys

WATERMARK_DELAY_S = 5
# Offsets that one task of an as-of join takes in order at a time.
OFFSET_SLICE = 4096


def late_flags(
    arrivals: DataFrame, partition: str, arrival: str, ts: str, unique: str, delay_s: int = WATERMARK_DELAY_S
) -> DataFrame:
    """Mark the records behind their source partition's high-water mark by more than the delay."""
    marked = running_max_before(arrivals, [partition], arrival, unique, ts, "high_water")
    behind = F.col(ts) < F.col("high_water") - F.make_dt_interval(secs=F.lit(delay_s))
    return marked.withColumn("late", F.coalesce(behind, F.lit(False)))


def late_audit(
    arrivals: DataFrame,
    partition: str,
    arrival: str,
    ts: str,
    unique: str,
    period_s: int,
    delay_s: int = WATERMARK_DELAY_S,
) -> DataFrame:
    """Records and late records per source partition and arrival period."""
    flags = late_flags(arrivals, partition, arrival, ts, unique, delay_s)
    return flags.groupBy(partition, period_start(F.col(arrival), period_s).alias("period")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("late").alias("late")
    )


def watermark_latency(output: Column, source: Column) -> Column:
    """Event-time latency: output watermark less input watermark."""
    return output - source


def lag_stats(
    df: DataFrame, keys: list[str], offset: str, event_time: str, consumed: Column
) -> DataFrame:
    """How far a consumer is behind per partition: latest and committed offset, their difference, and
    the event time between the latest record and the latest consumed one.

    A partition of which nothing is consumed has no committed offset; its lag counts from its first.
    """
    done = F.coalesce(consumed, F.lit(False))
    ends = df.groupBy(*keys).agg(
        F.max(offset).alias("latest_offset"), F.max(F.when(done, F.col(offset))).alias("committed_offset"),
        F.min(offset).alias("__first"), F.max(event_time).alias("__newest"), F.min(event_time).alias("__oldest"),
        F.max(F.when(done, F.col(event_time))).alias("__reached"),
    )
    reached = F.coalesce("__reached", "__oldest")
    return ends.select(
        *keys, "latest_offset", "committed_offset",
        (F.col("latest_offset") - F.coalesce(F.col("committed_offset"), F.col("__first") - 1)).alias("offset_lag"),
        (epoch_millis(F.col("__newest")) - epoch_millis(reached)).alias("millis_behind"),
    )


def as_of(points: DataFrame, index: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The rows of ``points`` with the ``value`` of the index row that has the greatest ``at`` not beyond
    theirs, by ``keys``; null where none has. Of index rows at one place the largest value counts.

    Both sides fall into slices of ``at``, which are summed up and scanned, so that no key is put in
    order as a whole: see ``running_max_before``. A point without a place has no value.
    """
    held = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    known = index.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col(at).alias("__at"), held.alias("__held"), F.lit(0).alias("__kind")
    )
    asked = points.select(
        *keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__point")
    )
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("__place", F.timestamp_seconds("__at"))
    found = running_max_before(both, keys, "__place", "__kind", "__held", "__found", slice_s=OFFSET_SLICE)
    value_there = F.when(F.col("__at").isNotNull(), F.col("__found.value"))
    return found.where("__kind = 1").select("__point.*", value_there.alias(value))


def time_lag(commits: DataFrame, index: DataFrame, keys: list[str], offset: str, ts: str) -> DataFrame:
    """Estimated time lag of every commit: the newest indexed time of its partition less the time that the
    index has for the committed offset, in milliseconds.

    The index maps some offsets to times and may be sparse; a commit before its first entry, or of a
    partition it does not know, has no lag.
    """
    newest = index.groupBy(*keys).agg(F.max(ts).alias("__newest"))
    reached = as_of(commits, index, keys, offset, ts)
    behind = (epoch_millis(F.col("__newest")) - epoch_millis(F.col(ts))).alias("millis_behind")
    return same_keys(reached, newest, keys, "left").select(*commits.columns, F.col(ts).alias("reached"), behind)
