"""Connected components of a link table by alternating large and small stars; helpers of several operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivulet.session import workspace


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage through a table in the folder that all executors share."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows for whose ``column`` the function says True; all columns come back as they were, whatever their names."""
    names = docs.columns
    place = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place)), pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links of longs to ``(u, v)`` with v the smallest id reachable from u, for every u but the smallest.

    Null ends and links of an id to itself are left out; repeated links count once; no links give an empty table.
    Rounds grow with the logarithm of the number of ids. Each round's links go through a table in the shared folder,
    so a lost executor costs one round at most, and the driver only sees two numbers a round.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    links, before = written(links, "links"), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return links
        before = mark
        links = written(_small_star(_large_star(links)), "links")
