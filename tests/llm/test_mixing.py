import random
from collections import defaultdict

from rivulet.llm import mixing
from tests.llm.helpers import documents, odd_texts, prose, tokens


def goals(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def corpus(spark):
    rows = [(k, prose(k, 40 + 7 * (k % 30)), f"s{k % 3}") for k in range(300)]
    rows += [(1000 + k, prose(k, 30), "tiny") for k in range(4)]
    rows += [(2000 + k, prose(k, 50), None) for k in range(40)]
    rows += [(3000 + k, text, "Ünusual") for k, text in enumerate(odd_texts())]
    return rows, documents(spark, rows)


def test_targets_sizes_and_repeats(spark):
    rows, docs = corpus(spark)
    got = mixing.mixture(mixing.measured(docs)).collect()
    size = {r[0]: len(tokens(r[1])) for r in rows}
    source = {r[0]: r[2] for r in rows}
    total = defaultdict(int)
    for i, s in source.items():
        total[s] += size[i]
    want, taken = goals(total), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[source[r.doc_id]] += r.taken
    assert want["tiny"] == 3 * total["tiny"] == taken["tiny"]
    for s, goal in want.items():
        copies = {r.copies for r in got if source[r.doc_id] == s and r["size"]}
        assert max(copies) - min(copies) <= 1, "whole epochs come before a part of one"
        left_out = [r["size"] for r in got if source[r.doc_id] == s and r.copies == min(copies)]
        assert goal - max(left_out) - 1 <= taken[s] <= goal + 1e-6


def test_reruns_agree_and_rows_multiply(spark):
    _, docs = corpus(spark)
    first = sorted((r.doc_id, r.copies) for r in mixing.mixture(mixing.measured(docs)).collect())
    again = mixing.mixture(mixing.measured(docs.repartition(7))).collect()
    assert first == sorted((r.doc_id, r.copies) for r in again)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in first if n}


def test_better_documents_come_first(spark):
    junk = " ".join(f"w{k}###" for k in range(50))
    rows = [(k, prose(k, 50) if k % 2 else junk, "a") for k in range(400)] + [(k, prose(k, 50), "b") for k in range(500, 600)]
    got = mixing.mixture(mixing.measured(documents(spark, rows))).where("doc_id < 500").collect()
    good, bad = sum(r.copies for r in got if r.doc_id % 2), sum(r.copies for r in got if not r.doc_id % 2)
    assert good > 2 * bad


def test_nulls_repeats_ties_and_no_rows(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "t"), (2, "", "u")]
    docs = documents(spark, rows).selectExpr("*", "7 AS size", "8 AS weight", "9 AS target")
    got = mixing.mixture(mixing.measured(docs)).collect()
    assert len(got) == 6 and sum(r.taken for r in got) <= 11
    assert {r.taken for r in got if not r["size"]} == {0}
    assert set(mixing.mixed(docs).columns) == set(docs.columns)
    assert mixing.mixture(mixing.measured(docs.where("false"))).count() == 0
    assert mixing.mixed(docs.where("false")).count() == 0
    only_empty = documents(spark, [(1, "", "s"), (2, None, "t")])
    assert [r.taken for r in mixing.mixture(mixing.measured(only_empty)).collect()] == [0, 0]


def test_no_document_that_is_left_out_fits(spark):
    draw = random.Random(5)
    rows = [(k, f"s{k % 6}", k, int(draw.lognormvariate(3, 2)) + 1, 1.0) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text_hash long, size long, weight double")
    got = mixing.mixture(table).collect()
    for source in {r[1] for r in rows}:
        own = [r for r in got if r.source == source]
        room = own[0].target - sum(r.taken for r in own)
        least = min(r.copies for r in own)
        if least < mixing.MOST_REPEATS:
            assert -1e-6 <= room < min(r["size"] for r in own if r.copies == least) + 1
