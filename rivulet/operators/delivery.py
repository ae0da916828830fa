"""Batched puts with retry, error routing and object layout."""

from __future__ import annotations

import os
import random
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rivulet.operators.ordered import same_keys
from rivulet.operators.packing import MAX_BYTES, MAX_RECORDS, by_invocation, number_batches, run_starts

# Only this error is retried, at most three times, after 1 to 5 seconds.
RETRYABLE = "ServiceUnavailableException"
MAX_RETRIES = 3
BACKOFF_S = (1, 5)

# Buffering limits (seconds, MiB) and compression names.
INTERVAL_S = (60, 900)
BUFFER_MB = (1, 128)
DEFAULT_INTERVAL_S = 300
DEFAULT_BUFFER_MB = 5
CODECS = {"GZIP": "gzip", "HADOOP_SNAPPY": "snappy", "Snappy": "snappy", "UNCOMPRESSED": "none"}

TIME_PREFIX = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}

DELIVERED, LOST = "delivered", "lost"

# Seconds that a failing delivery is tried again.
RETRY_S = (0, 7200)

PutClient = Callable[[list[str]], list[str | None]]
# Takes a batch whole; raises if it cannot.
Process = Callable[[list[str]], None]
Tried = tuple[list[int], list[str | None]]


def random_backoff() -> float:
    return random.randint(*BACKOFF_S)


def put_with_retry(
    lines: list[str],
    client: PutClient,
    retries: int | None = MAX_RETRIES,
    backoff: Callable[[], float] = random_backoff,
    retry_s: float | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> Tried:
    """Put one batch; attempts and last error per record, the error being null once delivered.

    The client answers one error code (or None) per record. Only records that failed with the
    retryable error are sent again, and never an empty batch: ``retries`` times at most, and not after
    ``retry_s`` seconds since the first put. Either bound may be None, but not both.
    """
    if retries is None and retry_s is None:
        raise ValueError("retries need a bound")
    if retry_s is not None:
        within(retry_s, RETRY_S, "retry duration")
    began, attempt = clock(), 1
    errors = list(client(lines))
    if len(errors) != len(lines):
        raise ValueError("the client must answer for every record")
    attempts = [1] * len(lines)
    pending = [i for i, error in enumerate(errors) if error == RETRYABLE]
    while pending and (retries is None or attempt <= retries):
        pause = backoff()
        if retry_s is not None and clock() + pause - began > retry_s:
            break
        time.sleep(pause)
        attempt += 1
        for i, error in zip(pending, client([lines[i] for i in pending]), strict=True):
            attempts[i], errors[i] = attempt, error
        pending = [i for i in pending if errors[i] == RETRYABLE]
    return attempts, errors


def process_bisecting(
    lines: list[str],
    process: Process,
    retries: int = MAX_RETRIES,
    backoff: Callable[[], float] = random_backoff,
) -> Tried:
    """Have one batch processed; attempts and last error per record, the error being null once done.

    A batch that fails is cut in two, the earlier half first, and each half is tried by itself, down to
    single records; only a failing single record is tried again, ``retries`` times. So a record is
    tried at most ``1 + ceil(log2(n)) + retries`` times, records keep their order, and one bad record
    costs about two calls per halving. Records of a failing batch may have been processed in part:
    processing must stand repetition.
    """
    attempts, errors = [0] * len(lines), [None] * len(lines)
    ranges = [(0, len(lines))] if lines else []
    while ranges:
        low, high = ranges.pop()
        tries = 1 + (retries if high - low == 1 else 0)
        for again in range(tries):
            if again:
                time.sleep(backoff())
            for i in range(low, high):
                attempts[i] += 1
            try:
                process(lines[low:high])
            except Exception as problem:
                failed = f"{type(problem).__name__}: {problem}"
            else:
                failed = None
                break
        if failed is not None and high - low > 1:
            middle = (low + high) // 2
            ranges += [(middle, high), (low, middle)]
        elif failed is not None:
            errors[low] = failed
    return attempts, errors


def put_batches(
    batches: Iterator[pa.RecordBatch],
    attempt: Callable[[list[str]], Tried],
    batch: list[str],
    keep: list[str],
    line: str,
) -> Iterator[pa.RecordBatch]:
    """Attempt every run of rows with the same ``batch`` columns; the last run may go on in the next
    Arrow batch and is held back until it is whole."""
    names = [*batch, *keep]

    def put(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
        lines = rows.column(line).to_pylist()
        attempts: list[int] = []
        errors: list[str | None] = []
        for low, high in zip(starts, [*starts[1:], len(lines)]):
            tried, failed = attempt(lines[low:high])
            attempts += tried
            errors += failed
        status = [LOST if error else DELIVERED for error in errors]
        return pa.RecordBatch.from_arrays(
            [
                *[rows.column(name).combine_chunks() for name in names],
                pa.array(attempts, pa.int32()),
                pa.array(status, pa.string()),
                pa.array(errors, pa.string()),
            ],
            names=[*names, "attempts", "status", "error"],
        )

    columns = list(dict.fromkeys([*names, line]))
    held: pa.Table | None = None
    for arrow in batches:
        rows = pa.Table.from_batches([arrow]).select(columns)
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        starts = np.flatnonzero(run_starts([rows.column(name).combine_chunks() for name in batch])).tolist()
        held = rows.slice(starts[-1])
        if len(starts) > 1:
            yield put(rows.slice(0, starts[-1]), starts[:-1])
    if held is not None:
        yield put(held, [0])


def _outcome_schema(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([
        *fields,
        T.StructField("attempts", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ])


def deliver(
    packed: DataFrame,
    make_client: Callable[[], PutClient],
    batch: list[str],
    keep: list[str],
    line: str = "line",
    retries: int | None = MAX_RETRIES,
    backoff: Callable[[], float] = random_backoff,
    retry_s: float | None = None,
) -> DataFrame:
    """Put the batches of ``pack_batches`` and report ``attempts``, ``status`` and ``error`` per record.

    Rows of a batch must follow one another within a task, as ``pack_batches`` leaves them. Each task
    uses one client. A retried task repeats its puts, so receivers should treat ``keep`` (topic,
    partition, offset) as the idempotency key.
    """
    schema = _outcome_schema([packed.schema[name] for name in [*batch, *keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        return put_batches(
            batches, lambda lines: put_with_retry(lines, client, retries, backoff, retry_s), batch, keep, line
        )

    return packed.select(*dict.fromkeys([*batch, *keep, line])).mapInArrow(run, schema)


def pack_and_deliver(
    df: DataFrame,
    make_client: Callable[[], PutClient],
    invocation: str,
    order: list[str],
    keep: list[str],
    line: str = "line",
    max_records: int = MAX_RECORDS,
    max_bytes: int = MAX_BYTES,
    retries: int | None = MAX_RETRIES,
    backoff: Callable[[], float] = random_backoff,
    retry_s: float | None = None,
) -> DataFrame:
    """``pack_batches`` and ``deliver`` in one pass, so that lines enter Python once."""
    batch = [invocation, "batch_no"]
    number = T.StructField("batch_no", T.LongType())
    schema = _outcome_schema([df.schema[invocation], number, *[df.schema[name] for name in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        numbered = number_batches(batches, invocation, max_records, max_bytes)
        return put_batches(
            numbered, lambda lines: put_with_retry(lines, client, retries, backoff, retry_s), batch, keep, line
        )

    needed = df.select(*dict.fromkeys([invocation, *order, *keep, line, "size"]))
    return by_invocation(needed, invocation, order).mapInArrow(run, schema)


def pack_and_process(
    df: DataFrame,
    make_process: Callable[[], Process],
    invocation: str,
    order: list[str],
    keep: list[str],
    line: str = "line",
    max_records: int = MAX_RECORDS,
    max_bytes: int = MAX_BYTES,
    retries: int = MAX_RETRIES,
    backoff: Callable[[], float] = random_backoff,
) -> DataFrame:
    """Ordered batches for a processor that takes or refuses a batch whole, halved where it refuses.

    One row per record with ``attempts``, ``status`` and ``error``, see ``process_bisecting``. Which
    records are bad need not be known; a batch's records wait for nothing but their own batch.
    """
    batch = [invocation, "batch_no"]
    number = T.StructField("batch_no", T.LongType())
    schema = _outcome_schema([df.schema[invocation], number, *[df.schema[name] for name in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = make_process()
        numbered = number_batches(batches, invocation, max_records, max_bytes)
        return put_batches(
            numbered, lambda lines: process_bisecting(lines, process, retries, backoff), batch, keep, line
        )

    needed = df.select(*dict.fromkeys([invocation, *order, *keep, line, "size"]))
    return by_invocation(needed, invocation, order).mapInArrow(run, schema)


def undelivered(outcomes: DataFrame) -> DataFrame:
    """What to write to the error prefix after the last retry."""
    return outcomes.where(F.col("status") == LOST).withColumn("error_type", F.lit("delivery"))


def delivery_report(outcomes: DataFrame, batch: list[str]) -> DataFrame:
    """Attempted, delivered, retried and lost records, and put calls, per batch."""
    delivered = F.col("status") == DELIVERED
    return outcomes.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(delivered).alias("delivered"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if(~delivered).alias("lost"),
        F.max("attempts").alias("calls"),
    ).withColumn("delivered_percent", F.col("delivered") * 100 / F.col("attempted"))


def with_time_prefix(df: DataFrame, ts: str) -> DataFrame:
    """``year``, ``month``, ``day`` and ``hour`` as zero-padded text."""
    return df.withColumns({part: F.date_format(ts, form) for part, form in TIME_PREFIX.items()})


def route_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to deliver and rows for the error prefix, split on ``error_type``."""
    return df.where(F.col("error_type").isNull()).drop("error_type"), df.where(F.col("error_type").isNotNull())


def mark_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that lack a partition key go to the error route."""
    missing = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), "partition_key")
    known = F.col("error_type") if "error_type" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error_type", F.coalesce(known, missing))


def mark_missing_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows without a line go to the error route: objects without a delimiter cannot hold them."""
    missing = F.when(F.col(line).isNull(), "line")
    known = F.col("error_type") if "error_type" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error_type", F.coalesce(known, missing))


def with_dead_letter(df: DataFrame, valid: Column, metadata: list[str], error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and for each invalid one its metadata and error: not its payload."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).select(*metadata, error.alias("error"))


def codec(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"compression {name!r} is not available; use one of {', '.join(CODECS)}")
    return CODECS[name]


def within(value: float, bounds: tuple[float, float], what: str) -> float:
    low, high = bounds
    if not low <= value <= high:
        raise ValueError(f"{what} must be between {low} and {high}, not {value}")
    return value


def _objects(batches: Iterator[pa.RecordBatch], prefix: list[str], line: str, limit: int, between: bytes) -> Iterator[pa.RecordBatch]:
    """Join the lines of rows sorted by prefix to whole objects of at most ``limit`` bytes; a longer
    line is an object by itself."""
    names = [*prefix, "value"]
    schema = None
    key, held, size = None, [], 0

    def flush() -> pa.RecordBatch:
        text = between.join(held).decode()
        return pa.RecordBatch.from_pylist([dict(zip(names, [*key, text]))], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([*[batch.schema.field(p) for p in prefix], pa.field("value", pa.string())])
        keys = list(zip(*[batch.column(p).to_pylist() for p in prefix])) or [()] * batch.num_rows
        for own, text in zip(keys, batch.column(line).to_pylist()):
            if text is None and not between:
                raise ValueError("a null line leaves no trace without a delimiter; see mark_missing_lines")
            # One newline ends a record, whether the line brings it or not; a null line is an empty record.
            data = (text or "").encode().removesuffix(b"\n")
            if held and (own != key or size + len(between) + len(data) + 1 > limit):
                yield flush()
                held, size = [], 0
            size += len(data) + (len(between) if held else 0)
            key = own
            held.append(data)
    if held:
        yield flush()


def write_objects(
    df: DataFrame,
    path: str,
    prefix: list[str],
    line: str = "line",
    buffer_mb: float = DEFAULT_BUFFER_MB,
    compression: str = "GZIP",
    delimiter: bool = True,
    mode: str = "append",
) -> None:
    """Write JSON objects, one per line, below ``path`` in files of at most ``buffer_mb`` (before
    compression). With ``delimiter=False`` the objects of a file simply follow one another, a newline
    ends the file, and null lines are refused.

    Rows are brought together by prefix, and adaptive execution cuts a hot prefix into several tasks
    and joins small ones. A task adds up the bytes of its lines and closes a file before the one that
    would exceed the buffer, so the number of files follows the volume; a line longer than the buffer
    has a file for itself. A task holds one file's text at a time.
    """
    limit = int(within(buffer_mb, BUFFER_MB, "buffer size") * 1024 * 1024)
    between = b"\n" if delimiter else b""
    schema = T.StructType([*[df.schema[p] for p in prefix], T.StructField("value", T.StringType())])
    whole = df.select(*prefix, line).hint("rebalance", *prefix).sortWithinPartitions(*prefix).mapInArrow(
        lambda batches: _objects(batches, prefix, line, limit, between), schema
    )
    (
        whole.write.mode(mode)
        .option("compression", codec(compression))
        .option("maxRecordsPerFile", 1)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*prefix)
        .text(path)
    )


# How Spark's readers expect the values of partition folders.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def _folder(prefix: list[str], values: tuple) -> str:
    def shown(text: str) -> str:
        return ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", text)

    return "/".join(f"{shown(p)}={shown(v) if v else NO_VALUE}" for p, v in zip(prefix, values))


def _local(df: DataFrame, path: str) -> str | None:
    """The path on a file system that driver and executors have mounted; None if it is anywhere else."""
    named = re.fullmatch("file:(?://)?(/.*)", path)
    if named or re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        return named and named[1]
    default = df.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
    return os.path.abspath(path) if default.startswith("file:") else None


def _put_files(batches: Iterator[pa.RecordBatch], stage: str, prefix: list[str], flush_size: int) -> Iterator[pa.RecordBatch]:
    """Write lines to files of ``flush_size`` each, a new one for each new prefix; the attempt's folder is the result."""
    own = f"{stage}/{uuid.uuid4().hex}"
    key, left, out = None, 0, None
    try:
        for batch in batches:
            keys = list(zip(*[batch.column(p).to_pylist() for p in prefix])) or [()] * batch.num_rows
            for at, line in zip(keys, batch.column("line").to_pylist()):
                if not left or at != key:
                    if out:
                        out.close()
                    folder = f"{own}/{_folder(prefix, at)}"
                    if at != key:
                        os.makedirs(folder, exist_ok=True)
                    key, left = at, flush_size
                    out = open(f"{folder}/part-{uuid.uuid4().hex}.json", "w", encoding="utf-8", newline="")
                out.write(line + "\n")
                left -= 1
    finally:
        if out:
            out.close()
    if out:
        yield pa.RecordBatch.from_pydict({"folder": [own]})


def _write_counted(dealt: DataFrame, path: str, prefix: list[str], flush_size: int) -> None:
    """Append JSON files of ``flush_size`` records, counted in each task from its first record of a prefix on.

    Spark's writer goes through Hadoop's local file system, which starts two processes for each file it makes
    on a mounted disk. There the tasks write the files themselves, each attempt into a folder of its own below
    ``_temporary``; when all have ended, the files of the attempts that count are moved to their place.
    """
    root = _local(dealt, path)
    if root is None:
        writer = dealt.write.mode("append").option("maxRecordsPerFile", flush_size)
        (writer.partitionBy(*prefix) if prefix else writer).json(path)
        return
    stage = f"{root}/_temporary/{uuid.uuid4().hex}"
    os.makedirs(stage)
    try:
        body = F.to_json(F.struct(*[c for c in dealt.columns if c not in prefix]))
        lines = dealt.select(*[F.make_valid_utf8(F.col(p).cast("string")).alias(p) for p in prefix], body.alias("line"))
        done = lines.mapInArrow(lambda batches: _put_files(batches, stage, prefix, flush_size), "folder string")
        for row in done.collect():
            for folder, _, names in os.walk(row.folder):
                place = f"{root}/{os.path.relpath(folder, row.folder)}"
                os.makedirs(place, exist_ok=True)
                for name in names:
                    os.rename(f"{folder}/{name}", f"{place}/{name}")
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    if not os.listdir(os.path.dirname(stage)):
        os.rmdir(os.path.dirname(stage))
    open(f"{root}/_SUCCESS", "w").close()


def write_fixed_count(df: DataFrame, path: str, flush_size: int, tasks: int) -> None:
    """JSON objects of ``flush_size`` records each, written by ``tasks`` tasks."""
    if flush_size < 1 or tasks < 1:
        raise ValueError("flush size and tasks must be at least 1")
    _write_counted(df.repartition(tasks), path, [], flush_size)


# Records that one task numbers in order at a time.
COUNT_SLICE = 65_536


def write_exact_count(
    df: DataFrame, path: str, prefix: list[str], unique: str, flush_size: int, tasks: int, slice_rows: int = COUNT_SLICE
) -> None:
    """JSON objects below ``path/<prefix>=/`` of exactly ``flush_size`` records each, but the last of a prefix,
    written by ``tasks`` tasks.

    Records are numbered within their prefix in two steps: slices (a hash of ``unique``) are counted and
    their counts summed up, then each slice numbers its own records from there. So a hot prefix is
    numbered by many tasks, and the records of one object, by their number, are written by one. Equal
    values of ``unique`` may stand in any order.
    """
    if flush_size < 1 or tasks < 1:
        raise ValueError("flush size and tasks must be at least 1")
    slices = df.count() // slice_rows + 1
    placed = df.withColumn("__slice", F.pmod(F.xxhash64(unique), F.lit(slices)))
    held = placed.groupBy(*prefix, "__slice").agg(F.count(F.lit(1)).alias("__held"))
    before = Window.partitionBy(*prefix).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*prefix, "__slice", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*prefix, "__slice").orderBy(unique)
    numbered = same_keys(placed, starts, [*prefix, "__slice"]).withColumn(
        "__number", F.col("__start") + F.row_number().over(inside) - 1
    )
    # Only full objects stand before others of their prefix in a task, so files end where objects do.
    dealt = numbered.withColumn("__object", F.floor(F.col("__number") / flush_size)).repartition(
        tasks, *prefix, "__object"
    ).sortWithinPartitions(*prefix, "__number")
    _write_counted(dealt.select(*df.columns), path, prefix, flush_size)
