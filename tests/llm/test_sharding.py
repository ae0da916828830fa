import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rivulet.llm import sharding
from tests.llm.helpers import documents, odd_texts, prose


def test_sizes_checksums_slots_and_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 8)
    rows = [(k, t) for k, t in enumerate(odd_texts() + [prose(k, 20) for k in range(600)])]
    got = sharding.sharded(documents(spark, rows)).collect()
    slots = defaultdict(list)
    for r in got:
        text = (dict(rows)[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, sharding.SHARDS)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 10 < sum(r.grown_shard == 16 for r in got) < 80
    again = sharding.sharded(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def placed(spark, nodes, n=8000):
    rows = sharding.place(spark.range(n).withColumnRenamed("id", "doc_id"), F.col("doc_id"), nodes, "shard")
    return {r.doc_id: r.shard for r in rows.collect()}


def test_shares_follow_weights(spark):
    nodes = {"north": {"a": {0: 1.0, 1: 3.0}, "b": {2: 2.0}}, "south": {"c": {3: 2.0, 4: 0.0}}}
    count = Counter(placed(spark, nodes).values())
    assert {s: round(count[s] / 1000) for s in range(5)} == {0: 1, 1: 3, 2: 2, 3: 2, 4: 0}


@pytest.mark.parametrize("rack, leaf, inside", [("a", 1, {0, 1, 2}), ("c", 4, {3, 4})])
def test_movement_stays_in_subtrees_whose_weights_change(spark, rack, leaf, inside):
    nodes = {"north": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0}}, "south": {"c": {3: 1.0, 4: 1.0}, "d": {5: 1.0}}}
    heavier = {r: {k: {s: 2.0 if s == leaf else w for s, w in leaves.items()} for k, leaves in racks.items()}
               for r, racks in nodes.items()}
    before, after = placed(spark, nodes), placed(spark, heavier)
    region = {0, 1, 2} if leaf < 3 else {3, 4, 5}
    for i, old in before.items():
        new = after[i]
        if old != new:
            assert new in region, "only into the region that grew"
            if old in region:
                assert new in ({0, 1} if leaf == 1 else {3, 4}), "within it only into the rack that grew"
                if old in ({0, 1} if leaf == 1 else {3, 4}):
                    assert new == leaf


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(None, "a"), (None, None), (3, "b"), (3, "b"), (3, "c")]
    docs = documents(spark, rows).selectExpr("*", "1 AS shard", "2 AS range", "3 AS inside", "4 AS size")
    got = sharding.sharded(docs).collect()
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert sorted((r.shard, r.slot) for r in got) == sorted(set((r.shard, r.slot) for r in got))
    assert sharding.sharded(docs.where("false")).count() == 0
    assert sharding.assigned(docs).columns == docs.columns
