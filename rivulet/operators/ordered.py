"""Ordered computations over keys of any size.

A window over one key runs in one task, which a hot key overwhelms. Here rows fall into slices of
time that are a pure function of the row, so a hot key is spread over many slices. Slices are
summarised with map-side combining, the summaries are scanned in two steps (within a day, and over
days) to give what came before each slice, and every row combines its slice-local value with that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# A slice is a second; a key's day holds at most 86 400 of them.
SLICE_S, SPAN_S = 1, 86_400


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys and keeps one copy of them."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    matches = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, matches, how).drop(*[f"__{k}" for k in keys])


def running_max_before(
    df: DataFrame, keys: list[str], at: str, unique: str, value: str, out: str, slice_s: int = SLICE_S
) -> DataFrame:
    """Largest ``value`` among the rows that precede each row in its key by time ``at``, then by
    ``unique``; null for the first row."""
    slice_no = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (slice_s * 1_000_000))
    rows = df.withColumn("__slice", slice_no)
    totals = rows.groupBy(*keys, "__slice").agg(F.max(value).alias("__total")).withColumn(
        "__span", F.floor(F.col("__slice") * slice_s / SPAN_S)
    )

    def before(*parts: str, order: str):
        return Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    spans = totals.groupBy(*keys, "__span").agg(F.max("__total").alias("__total"))
    earlier = spans.select(*keys, "__span", F.max("__total").over(before(*keys, order="__span")).alias("__earlier"))
    inside = totals.withColumn("__inside", F.max("__total").over(before(*keys, "__span", order="__slice")))
    carry = same_keys(inside, earlier, [*keys, "__span"]).select(
        *keys, "__slice", F.greatest("__inside", "__earlier").alias("__carry")
    )
    local = Window.partitionBy(*keys, "__slice").orderBy(at, unique).rowsBetween(Window.unboundedPreceding, -1)
    return same_keys(rows, carry, [*keys, "__slice"]).withColumn(
        out, F.greatest(F.max(value).over(local), "__carry")
    ).drop("__slice", "__carry")
