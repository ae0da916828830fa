"""Hash-range shard assignment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shards a stream may have.
SHARD_COUNT = (1, 200)

HASH_BITS = 32
HASH_SPACE = 1 << HASH_BITS


def shard_of(key: Column, shards: int) -> Column:
    """Shard number in ``[0, shards)``: the top 32 hash bits scaled onto equal ranges."""
    low, high = SHARD_COUNT
    if not low <= shards <= high:
        raise ValueError(f"shards must be between {low} and {high}")
    top_bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.shiftright(top_bits * shards, HASH_BITS).cast("int")


def uniform(seed: int, key: Column, label: str) -> Column:
    """A repeatable draw from [0, 1) that depends only on the row's key, not on its partition."""
    digest = F.md5(F.concat_ws(":", F.lit(label), F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(HASH_SPACE))
