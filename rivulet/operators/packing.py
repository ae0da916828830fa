"""Packing the records of an invocation into put batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rivulet.functions.payload import json_line

# A put batch holds at most 500 records and 4 MiB; an invocation at most 10 000 records.
MAX_RECORDS = 500
MAX_BYTES = 4_194_304
MAX_INVOCATION = 10_000


def to_lines(df: DataFrame, columns: list[str], keep: list[str], out: str = "line") -> DataFrame:
    """The whole record as one JSON line, newline included, with its size in bytes."""
    line = F.concat(json_line(columns), F.lit("\n"))
    return df.select(*keep, line.alias(out)).withColumn("size", F.octet_length(out).cast("bigint"))


def invocation_of(position: Column, max_records: int) -> Column:
    """Invocation number of a record from its unique, ascending position: no invocation can hold
    more than ``max_records``."""
    if not 1 <= max_records <= MAX_INVOCATION:
        raise ValueError(f"an invocation takes 1 to {MAX_INVOCATION} records")
    return F.call_function("div", position, F.lit(max_records))


def split_oversize(df: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Records that fit a put batch, and those that alone exceed it (for the error route)."""
    fits = F.col("size") <= max_bytes
    return df.where(fits), df.where(~fits).withColumn("error_type", F.lit("oversize"))


def pack_by_count(
    df: DataFrame, invocation: str, order: list[str], max_records: int = MAX_RECORDS
) -> DataFrame:
    """Batch numbers where sizes cannot matter: plain arithmetic on the position in the invocation."""
    position = F.row_number().over(Window.partitionBy(invocation).orderBy(*order)) - 1
    return df.withColumn("batch_no", F.floor(position / max_records) + 1)


def run_starts(columns: list[pa.Array]) -> np.ndarray:
    """True where any of the columns differs from the row before; always true for the first row."""
    starts = np.zeros(len(columns[0]), dtype=bool)
    starts[:1] = True
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    return starts


def number_batches(
    batches: Iterator[pa.RecordBatch], invocation: str, max_records: int, max_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Add ``batch_no`` to sorted Arrow batches; an invocation may go on in the next one."""
    current, number, records, used = object(), 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(invocation)
        begins = run_starts([keys])
        begins[0] = keys[0].as_py() != current
        total = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy(zero_copy_only=False))])
        numbers = np.empty(batch.num_rows, dtype=np.int64)
        edges = np.unique(np.concatenate([[0], np.flatnonzero(begins), [batch.num_rows]]))
        for low, high in zip(edges[:-1], edges[1:]):
            if begins[low]:
                number, records, used = 1, 0, 0
            at = low
            while at < high:
                room = int(np.searchsorted(total, total[at] + max_bytes - used, side="right")) - 1
                stop = min(high, at + max_records - records, room)
                if stop == at and not records:
                    raise ValueError("a record exceeds max_bytes: apply split_oversize first")
                numbers[at:stop] = number
                if stop < high:
                    number, records, used = number + 1, 0, 0
                else:
                    records, used = records + int(stop - at), used + int(total[stop] - total[at])
                at = stop
        current = keys[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "batch_no"]
        )


def by_invocation(df: DataFrame, invocation: str, order: list[str]) -> DataFrame:
    """Invocations spread over the tasks, each in order and in one piece."""
    return df.repartition(invocation).sortWithinPartitions(invocation, *order)


def pack_batches(
    df: DataFrame,
    invocation: str,
    order: list[str],
    max_records: int = MAX_RECORDS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Greedy packing in order: a batch closes when one more record would exceed either limit.

    Rows need ``size``, none above ``max_bytes`` (see ``split_oversize``). A task streams through its
    sorted rows and remembers only the open batch, so memory does not depend on the size of an
    invocation. The output keeps that order, which ``deliver`` relies on.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("batch_no", T.LongType())])
    return by_invocation(df, invocation, order).mapInArrow(
        lambda batches: number_batches(batches, invocation, max_records, max_bytes), schema
    )


def batch_sizes(packed: DataFrame, invocation: str = "invocation") -> DataFrame:
    return packed.groupBy(invocation, "batch_no").agg(
        F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes")
    )
