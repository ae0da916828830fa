"""Redistribution of records over tasks and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivulet.functions.shards import shard_of


def rebalance(df: DataFrame, n: int) -> DataFrame:
    """Round-robin over ``n`` tasks, whatever the keys look like."""
    return df.repartition(n)


def route_by_key(df: DataFrame, n: int, key: str, spread: Column | None = None) -> DataFrame:
    """Same key, same task. ``spread`` (a small salt column) splits keys too hot for one task; rows
    then keep together by (key, spread)."""
    return df.repartition(n, F.col(key)) if spread is None else df.repartition(n, F.col(key), spread)


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    return df.withColumn(out, shard_of(F.col(key), shards))


def shard_load(df: DataFrame, size: Column, by: str = "shard") -> DataFrame:
    """Records and bytes per shard; partial sums are combined before the shuffle."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"))
