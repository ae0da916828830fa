"""Line dedup over levelled sorted runs, in DataFrame expressions only.

The index holds one row per line key ever seen, with the document that holds it, in runs that are bucketed and sorted
by the key's hash. A batch's keys are aggregated and dealt out once, into a table of the same buckets; from there on
everything is a merge of buckets without a shuffle: the anti-join with every run leaves the new keys, which become a
run of level 0, and the join with the runs then gives every key's holder. When a level would have ``FANOUT`` runs they
are merged with the new one, by outer joins of their disjoint keys, into one run of the next level, so a key is
rewritten once per level and lookups meet a logarithmic number of runs. Batches come in ascending order of doc_id, so
that the holder is the smallest id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.llm.components import written
from rivulet.session import workspace

LEAST_LENGTH = 10
BATCHES = 4
FANOUT = 2
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)
    # lower() would change letters beyond A-Z too; where there are none it is the quicker way.
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_rows(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, text_hash, pos and the key's 128-bit hash (a, b) of every line whose key is long enough."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    keys = lines.where(F.char_length("line") >= least).withColumn("key", line_key(F.col("line")))
    return keys.where(F.char_length("key") >= least).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")
    )


KEY = ["a", "b"]


class LineRuns:
    """The levelled runs. They are bucketed tables below the shared folder; ``close`` takes them off the catalog."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """Written as one sorted file a bucket; rows that are dealt by the key already are not dealt again."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option(
            "path", workspace(self.spark, "line-run")
        ).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``key_rows`` whose ids follow those before; returns its lines to drop."""
        ends = lines.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        keys = self._bucketed(ends)
        new = keys.select(*KEY, F.col("first").alias("holder"))
        for run in self.runs():
            new = new.join(run.hint("merge"), KEY, "left_anti")
        self._keep(new)
        repeated = None
        for run in self.runs():
            own = keys.join(run.hint("merge"), KEY).where("last <> holder").select(*KEY, "holder")
            repeated = own if repeated is None else repeated.unionByName(own)
        # A table of its own, so that both sides are dealt out by the join, which then can cut a line that is everywhere.
        repeated = written(repeated, "line-holders")
        return lines.join(repeated, KEY).where("doc_id <> holder").select("doc_id", "text_hash", "pos")

    def _keep(self, rows: DataFrame) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            if len(self.levels[level]) + 1 < self.fanout:
                self.levels[level].append(self._bucketed(rows))
                return
            # No key is in two runs: an outer join of sorted runs is their merge.
            for run in self.levels[level]:
                other = run.withColumnRenamed("holder", "other")
                rows = rows.join(other.hint("merge"), KEY, "full_outer").select(
                    *KEY, F.coalesce("holder", "other").alias("holder")
                )
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], []


def in_order(docs: DataFrame, batches: int) -> Column:
    """The number of a document's batch; batches are ranges of doc_id of about equal size."""
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col("doc_id") > F.lit(int(cut))).cast("int")
    return number


def deduplicated(docs: DataFrame, least: int = LEAST_LENGTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, text (the kept lines), n_lines and n_dropped of every row.

    A line goes if its key has at least ``least`` code points and a document of smaller doc_id holds it too. A null or
    empty text is one empty line. Rows that repeat a doc_id are one document, so they drop nothing from each other; a
    null doc_id takes no part and keeps all its lines. Other columns are not looked at. No rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = workspace(docs.sparkSession, "lines")
    keyed = key_rows(rows, least).withColumn("batch", in_order(docs.select("doc_id"), batches))
    keyed.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(keyed.schema).parquet(path)
    runs, drops = LineRuns(docs.sparkSession), None
    for batch in range(batches):
        own = written(runs.add(lines.where(F.col("batch") == batch).drop("batch")), "line-drops")
        drops = own if drops is None else drops.unionByName(own)
    runs.close()
    gone = drops.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    every = F.split("text", "\n")
    found = rows.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left").withColumn(
        "gone", F.coalesce("gone", F.array().cast("array<int>"))
    ).withColumn("lines", every)
    # Between two dropped lines stands a slice that is kept; this reads each line once.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat("gone", F.array(F.size("lines")))
    pieces = F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return found.select(
        "doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
