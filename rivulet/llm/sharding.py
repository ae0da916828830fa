"""Shards by a hierarchical weighted hash tree, in DataFrame expressions only.

The tree has regions, racks and shards. At each level every child draws ``-ln(u) / weight`` with u hashed from the
document's id, the level and the child's name, and the smallest draw wins. A child's draw depends on nothing but the
id and its own weight, so a change of weight moves documents only into or out of the subtrees whose weights change,
and documents inside other subtrees stay where they are. A shard that is added comes as a region of its own: documents
move only into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 16
LEVELS = (2, 2, 4)
SLOT_ROWS = 16_384
SEED = 77

Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int = SHARDS, levels: tuple[int, int, int] = LEVELS) -> Tree:
    """Region, rack, shard number, weight. The first shards fill the levels; each further one is its own region."""
    regions, racks, leaves = levels
    out: Tree = {}
    for shard in range(shards):
        if shard < regions * racks * leaves:
            region, rack = f"region{shard // (racks * leaves)}", f"rack{shard // leaves % racks}"
        else:
            region, rack = f"region{regions + shard - regions * racks * leaves}", "rack0"
        out.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return out


def draw(key: Column, level: str, child: str, weight: float) -> Column:
    """A child's draw for a key; the smallest one wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{child}"), F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(
        float(1 << 53)
    )
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, level: str, children: dict[str, float]) -> Column:
    """Name of the child with the smallest draw; of equal draws the first name's."""
    live = {name: weight for name, weight in children.items() if weight > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_min(F.array(*(
        F.struct(draw(key, level, name, weight).alias("draw"), F.lit(name).alias("name"))
        for name, weight in live.items()
    )))["name"]


def _choice(at: Column, options: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, value in options.items():
        out = F.when(at == name, value) if out is None else out.when(at == name, value)
    return otherwise if out is None else out.otherwise(otherwise)


def place(docs: DataFrame, key: Column, nodes: Tree, name: str) -> DataFrame:
    """Add the shard of ``key`` in the tree as int column ``name``: three draws, each among one node's children."""
    weight = {r: {k: sum(leaves.values()) for k, leaves in racks.items()} for r, racks in nodes.items()}
    region, rack = f"_{name}_region", f"_{name}_rack"
    found = docs.withColumn(region, _least(key, "region", {r: sum(w.values()) for r, w in weight.items()}))
    racks = {r: F.concat(F.lit(f"{r}/"), _least(key, r, w)) for r, w in weight.items()}
    found = found.withColumn(rack, _choice(F.col(region), racks, F.lit(None).cast("string")))
    leaves = {
        f"{r}/{k}": _least(key, f"{r}/{k}", {str(s): w for s, w in shards.items()})
        for r, inner in nodes.items() for k, shards in inner.items()
    }
    shard = _choice(F.col(rack), leaves, F.lit(None).cast("string")).cast("int")
    return found.withColumn(name, shard).drop(region, rack)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``key``: doc_id and the number of shards decide (a null doc_id is a key like any other), and one more
    shard takes rows only into itself. Size is the text's UTF-8 bytes plus 1; a null text is empty. Slots number the
    rows of a shard from 0 without gaps; they are dealt in hashed ranges, so that no task orders a whole
    shard, and within a range by doc_id, checksum and size. Rows that repeat a doc_id share a shard and have slots of
    their own. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = place(place(rows, F.col("doc_id"), tree(shards), "shard"), F.col("doc_id"), tree(shards + 1), "grown_shard")
    ranges = max(1, docs.count() // (shards * SLOT_ROWS))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(SEED + 1)), F.lit(ranges)))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "range").agg(F.count("*").alias("held")).select(
        "shard", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("inside")).alias("slot"), "grown_shard",
    )


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with their columns and the shard of their doc_id; a column named shard is replaced.

    Reads doc_id alone; all other columns come back as they were, whatever their names. A null doc_id is a key like any
    other, rows that repeat a doc_id share a shard, null and empty texts are rows like any other. No rows give no rows.
    """
    rows = docs.drop("shard").select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return place(rows, F.col("id"), tree(shards), "shard").select("row.*", "shard")
