"""Windowed statistics on live streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rivulet.operators.lag import WATERMARK_DELAY_S
from rivulet.operators.metrics import MINUTE, SKETCH_K, STATS
from rivulet.operators.ordered import running_max_before, same_keys
from rivulet.session import fixed_table
from rivulet.sources.streams import WATERMARK_DELAY
from rivulet.streaming.sinks import _trigger


def metric_stream(
    points: DataFrame, keys: list[str], period_s: int, ts: str = "ts", value: str = "value",
    delay: str = WATERMARK_DELAY,
) -> DataFrame:
    """Period statistics of a stream. State is one row per key and open period."""
    period = F.window(ts, f"{period_s} seconds")
    grouped = points.withWatermark(ts, delay).groupBy(period.alias("window"), *keys)
    stats = grouped.agg(
        F.count(value).alias("datapoints"), *[agg(F.col(value)).alias(name) for name, agg in STATS.items()]
    )
    return stats.select(F.col("window.start").alias("period"), *keys, "datapoints", *STATS)


def sketch_stream(
    points: DataFrame, keys: list[str], period_s: int = MINUTE, ts: str = "ts", value: str = "value",
    delay: str = WATERMARK_DELAY, k: int = SKETCH_K,
) -> DataFrame:
    """Quantile sketches of a stream, the rows of ``metrics.quantile_sketches``. State is one sketch per key
    and open period; ``metrics.merged_quantile`` reads percentiles of any coarser period from its table."""
    period = F.window(ts, f"{period_s} seconds")
    grouped = points.withWatermark(ts, delay).groupBy(period.alias("window"), *keys)
    return grouped.agg(
        F.count(value).alias("datapoints"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")
    ).select(F.col("window.start").alias("period"), *keys, "datapoints", "sketch")


def latest_to_table(
    stats: DataFrame, path: str, checkpoint: str, mode: str = "update", every_s: int | None = None
) -> StreamingQuery:
    """Write each micro-batch's statistics below ``path``, one folder per batch.

    In update mode a batch holds the periods it changed, so state and output follow the open periods;
    ``read_latest`` gives the newest row of each. In append mode all folders together are the table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return (
        stats.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every_s))
        .start()
    )


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch per period and key."""
    values = [c for c in rows.columns if c not in ("period", "batch", *keys)]
    newest = rows.groupBy("period", *keys).agg(
        F.max_by(F.struct(*values), "batch").alias("__row"), F.max("batch").alias("batch")
    )
    return newest.select("period", *keys, "__row.*", "batch")


def read_latest(spark, path: str, keys: list[str]) -> DataFrame:
    """The newest row per period and key of an update-mode table, compacted or not."""
    parts = folders(spark, path)
    rows = spark.read.parquet(path) if not parts else spark.read.parquet(*parts)
    return _newest(rows, keys).drop("batch")


# Folders of one level that are merged into one of the next.
MERGE_AT = 8
MANIFEST = "level int, upto long, folder string, version long"


def folders(spark, path: str, before: int | None = None) -> list[str] | None:
    """The folders that make up a compacted table; None if the table has no manifest."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, slot int").parquet(f"{path}_manifest")
        wanted = rows if before is None else rows.where(F.col("version") < before)
        last = wanted.agg(F.max("version")).first()[0]
        return [] if last is None else sorted(r.folder for r in wanted.where(F.col("version") == last).collect())
    except AnalysisException:
        return None


def compacting_to_table(
    stats: DataFrame, path: str, checkpoint: str, keys: list[str], every_s: int | None = None,
    merge_at: int = MERGE_AT,
) -> StreamingQuery:
    """``latest_to_table`` in update mode, with folders merged level by level.

    Each micro-batch writes one folder of level 0. When a level has ``merge_at`` folders, they are merged
    into one of the next level, which keeps the newest row per period and key; so a row is rewritten once a
    level and n micro-batches leave at most ``merge_at`` folders for each of log(n) levels. A manifest
    lists the folders that count; the last two versions of it take turns in two places. It is written last:
    until then readers see the version before, and a repeated micro-batch starts from that, too. Folders
    that no version lists any more can be removed at leisure.
    """
    spark = stats.sparkSession

    def folder(level: int, upto: int) -> str:
        return f"{path}/level={level}/upto={upto}"

    def write(batch: DataFrame, epoch: int) -> None:
        held = {}
        for name in folders(spark, path, before=epoch) or []:
            level = int(name.split("/level=")[1].split("/")[0])
            held.setdefault(level, []).append(name)
        rows, level = batch.withColumn("batch", F.lit(epoch).cast("long")), 0
        while len(held.get(level, [])) + 1 >= merge_at:
            merged = spark.read.parquet(*held.pop(level))
            rows, level = _newest(rows.unionByName(merged), keys), level + 1
        rows.write.mode("overwrite").parquet(folder(level, epoch))
        held.setdefault(level, []).append(folder(level, epoch))
        listed = [(k, int(n.split("/upto=")[1]), n, epoch) for k, names in held.items() for n in names]
        table = fixed_table(spark, listed, MANIFEST).withColumn("slot", F.lit(epoch % 2))
        table.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "slot"
        ).parquet(f"{path}_manifest")

    return (
        stats.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every_s))
        .start()
    )


def late_rows_sink(
    arrivals: DataFrame, path: str, checkpoint: str, partition: str, arrival: str, ts: str, unique: str,
    delay_s: int = WATERMARK_DELAY_S, every_s: int | None = None,
) -> StreamingQuery:
    """Split a live stream by its source partitions' own high-water marks: ``late=false`` and ``late=true`` below
    ``path/rows``, as ``lag.late_flags`` would mark them.

    Micro-batches follow the arrival; within one, rows are in order of arrival. What goes from one to the next is
    the mark of each source partition, one row each below ``path/marks``; the marks before a micro-batch are those
    of the largest number below its own, so a repeated one finds the same. Within a micro-batch rows are
    scanned in slices, so a hot source partition is no single task. Late rows are kept, not dropped.
    """
    spark = arrivals.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        kind = arrivals.schema[ts].dataType.simpleString()
        shape = f"{partition} {arrivals.schema[partition].dataType.simpleString()}, mark {kind}, batch long"
        try:
            every = spark.read.schema(shape).parquet(f"{path}/marks").where(F.col("batch") < epoch)
            last = every.agg(F.max("batch")).first()[0]
            marks = every.where(F.col("batch") == F.lit(last)).drop("batch")
        except AnalysisException:
            marks = spark.createDataFrame([], shape).drop("batch")
        inside = running_max_before(batch, [partition], arrival, unique, ts, "__inside")
        high = F.greatest("__inside", "mark")
        behind = F.col(ts) < high - F.make_dt_interval(secs=F.lit(delay_s))
        flagged = same_keys(inside, marks, [partition], "left").withColumn("late", F.coalesce(behind, F.lit(False)))
        rows = flagged.select(*arrivals.columns, "late", F.lit(epoch).cast("long").alias("batch"))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("late", "batch").parquet(f"{path}/rows")
        seen = batch.select(partition, F.col(ts).alias("mark")).unionByName(marks)
        reached = seen.groupBy(partition).agg(F.max("mark").alias("mark"))
        reached.write.mode("overwrite").parquet(f"{path}/marks/batch={epoch}")

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every_s))
        .start()
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that queries dropped behind their watermark, over their whole life.

    Add it with ``spark.streams.addListener``; ``dropped`` holds the counts by query id.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        name = str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
