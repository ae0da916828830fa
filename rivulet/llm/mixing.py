"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A document's key is ``-ln(u) / weight`` with u drawn by hashing its id, so better documents tend to come first and
every run draws the same. A source's token budget first takes whole epochs of the source; the rest goes to documents
in the order of their keys, as far as the running sum of their sizes stays within it. Room left by a document that did
not fit goes, in the same order, to later ones that do, until no document that is left out fits.

The running sum is kept apart by source and by slices of the key: slices are summed first, and only the slice in which
a budget ends is put in order, so that no source is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rivulet.llm import words
from rivulet.llm.components import written

MOST_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
SLICE_ROWS = 4096
SEED = 11
SYMBOLS = np.zeros(256, dtype=np.uint8)
SYMBOLS[[ord(c) for c in "#$%&*|~^<>{}!"]] = 1


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.get_field_index("text")
        size, weight = [], []
        for _, _, data, offsets in words.slices(batch.column(place)):
            _, _, first = words.spans(data, offsets)
            marks = np.concatenate([[0], np.cumsum(SYMBOLS[data], dtype=np.int64)])
            count = np.diff(first)
            size.append(count)
            weight.append(1.0 / (1.0 + 10.0 * np.diff(marks[offsets]) / np.maximum(count, 1)))
        none = np.zeros(0)
        columns = [c for k, c in enumerate(batch.columns) if k != place]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.concatenate(size or [none]), pa.int64()),
             pa.array(np.concatenate(weight or [none]), pa.float64())],
            [*names, "size", "weight"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and quality weight of whole texts; null texts have size 0.

    The weight falls from 1 with the share of symbols that prose hardly has, so junk is repeated last.
    """
    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_measured, "doc_id long, source string, text_hash long, size long, weight double")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: each source's share of all sizes by weight, at most ``most`` times its own size.

    Sources by code point, null last, take ``weights`` in turn. What a capped source cannot use is shared by the
    others' weights until none is above its cap: the level at which the sum of min(weight x level, cap) is all sizes,
    found with running sums over the sources in the order in which they reach their caps.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("share", turn).withColumn("cap", F.col("source_size") * float(most))
    reach = [F.col("cap") / F.col("share"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*reach).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*reach).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "share"
    ).over(onward)
    # Sources before the first open one are capped; its level is the final one, and later rows only reach lower.
    capped = weighed.withColumn("level", level).withColumn("open", F.col("share") * F.col("level") < F.col("cap"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open"), F.col("share") * final).otherwise(F.col("cap"))
    return capped.select("source", "source_size", "source_rows", target.alias("target"))


def _fill(rows: DataFrame, left: Column) -> DataFrame:
    """Mark as ``fits`` the rows, in the order of their keys within a source, whose running size stays within ``left``.

    ``rows`` has source, slice, key, doc_id, text_hash, size, want (candidates); adds fits and used (their total).
    """
    wanted = F.when(F.col("want"), F.col("size")).otherwise(0)
    slices = rows.groupBy("source", "slice").agg(F.sum(wanted).alias("in_slice"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(up_to), F.lit(0)))
    # Null sources are a source of their own.
    slices = slices.select(F.col("source").alias("s"), F.col("slice").alias("k"), "before", "in_slice")
    placed = rows.join(slices, rows.source.eqNullSafe(slices.s) & (rows.slice == slices.k)).drop("s", "k")
    cut = (F.col("before") <= left) & (F.col("before") + F.col("in_slice") > left)
    order = Window.partitionBy("source", "slice", "cut").orderBy("key", "doc_id", "text_hash").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = placed.withColumn("cut", cut)
    inside = placed.where("cut").withColumn("running", F.col("before") + F.sum(wanted).over(order)).withColumn(
        "fits", F.col("want") & (F.col("running") <= left)
    ).drop("running")
    whole = placed.where("NOT cut").withColumn("fits", F.col("want") & (F.col("before") + F.col("in_slice") <= left))
    return whole.unionByName(inside).drop("cut", "before", "in_slice")


def mixture(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken and copies for rows of doc_id, source, text_hash, size, weight.

    ``taken`` is size x copies; a document is taken at most ``most`` times. A source's taken words fall short of its
    target by less than the smallest document that was left out and one word, and never exceed it. Rows without
    words are taken as often as their source's epochs. Null or non-positive weights count as the smallest positive
    weight, rows that repeat a document are documents of their own, ties in the key go by id, then text. Each null
    source row belongs to the one null source. No rows give no rows.
    """
    goals = targets(rows, weights, most)
    share = F.greatest(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)), F.lit(1e-6))
    # 2^53 steps, never 0 or 1.
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    goal = goals.select(
        F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("source_rows") / SLICE_ROWS).alias("slices"),
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
        .otherwise(F.lit(0)).alias("epochs"),
    ).withColumn("rest", F.greatest(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0)))
    state = rows.join(goal, rows.source.eqNullSafe(goal.s)).drop("s").withColumn("key", -F.log(u) / share)
    # A slice is a range of 1 - exp(-key), which is even where weights are equal.
    state = state.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * F.col("slices"))).withColumn(
        "chosen", F.lit(False)
    )
    room = F.col("epochs") < most
    fitting = room & ~F.col("chosen") & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    # The first fitting document is always taken, so every round leaves less room.
    while not state.where(fitting).isEmpty():
        state = state.withColumn("want", fitting)
        state = written(_fill(state, F.col("rest")), "fill")
        used = state.where("fits").groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "s")
        state = state.join(used, state.source.eqNullSafe(used.s), "left").withColumn(
            "rest", F.col("rest") - F.coalesce("used", F.lit(0))
        ).withColumn("chosen", F.col("chosen") | F.col("fits")).drop("s", "used", "want", "fits")
    copies = F.col("epochs") + F.col("chosen").cast("long")
    return state.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
        copies.alias("copies"),
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with their columns.

    Reads doc_id, source and text; all columns come back as they were, whatever their names. A null source is a source
    of its own, a null doc_id an id like any other. Null and empty texts have no words and are taken as often as their
    source's whole epochs. Rows that repeat (same id, source and text) share what the mix takes of them as evenly as it
    goes. No rows give no rows.
    """
    plan = mixture(measured(docs), weights, most).groupBy("doc_id", "source", "text_hash").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("equal")
    ).where("copies > 0")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("origin"),
        F.xxhash64("text").alias("own"),
    )
    same = rows.id.eqNullSafe(plan.doc_id) & rows.origin.eqNullSafe(plan.source) & (rows.own == plan.text_hash)
    turn = F.row_number().over(Window.partitionBy("doc_id", "source", "text_hash").orderBy("own"))
    taken = F.expr("copies div equal") + (F.col("turn") <= F.col("copies") % F.col("equal")).cast("long")
    each = rows.join(plan, same).withColumn("turn", turn).withColumn("taken", taken).where("taken > 0")
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken")))).select("row.*")
