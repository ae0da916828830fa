import random

import numpy as np

from rivulet.llm import decontam
from tests.llm.helpers import documents, odd_texts, prose

ITEMS = "item_id long, text string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def planted(seed=1):
    bench = [(k, prose(500 + k, 15 + 3 * k)) for k in range(15)] + [(90, prose(590, 420))]
    rows = [(k, prose(seed * 1000 + k, 150)) for k in range(60)]
    want = set()
    for k, (item, text) in enumerate(bench):
        for turn, shape in enumerate((str, str.upper, lambda t: t.replace(" ", "***  "))):
            doc = 3 * k + turn
            own = rows[doc][1].split(" ")
            rows[doc] = (doc, " ".join([*own[: 7 * turn + 5], shape(text), *own[7 * turn + 5 :]]))
            want.add((doc, item))
    return bench, rows, want


def test_planted_passages_and_nothing_else(spark):
    bench, rows, want = planted()
    docs, benchmark = documents(spark, rows), items(spark, bench)
    got = decontam.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity > 0.99 for r in got)
    text = dict(rows)
    for r in got:
        n = len(dict(bench)[r.item_id].split())
        assert r.n_words == n
        first = dict(bench)[r.item_id].split()[0].lower().strip(".")
        assert text[r.doc_id].lower().replace("***", " ").split()[r.start].startswith(first)
    small = decontam.contaminated(docs, benchmark, block_bytes=300).collect()
    assert {(r.doc_id, r.item_id) for r in small} == want
    left = decontam.cleaned(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(text) - {d for d, _ in want}


def test_lightly_edited_passages(spark):
    bench = [(1, prose(700, 60))]
    words, rows = bench[0][1].split(" "), []
    rows.append((1, prose(1, 50) + " " + " ".join(words[:30] + ["changed"] + words[31:])))
    rows.append((2, prose(2, 50) + " " + " ".join(words[3:]) + " " + prose(3, 50)))
    rows.append((3, prose(4, 50) + " " + " ".join(words[:20]) + " " + prose(5, 50)))
    got = decontam.contaminated(documents(spark, rows), items(spark, bench)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert all(0.8 <= r.similarity < 1 for r in got)


def test_simhashes_match_bit_counts():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 500, dtype=np.uint64)
    for size, stride in ((1, 1), (12, 4), (200, 50), (254, 3), (255, 7), (480, 3)):
        got = decontam.simhashes(hashes, size, stride)
        assert len(got) == len(range(0, 500 - size + 1, stride))
        for at, value in zip(range(0, 500 - size + 1, stride), got.tolist()):
            count = [sum(int(h) >> b & 1 for h in hashes[at : at + size]) for b in range(64)]
            assert value == sum((c >= size // 2 + 1) << b for b, c in enumerate(count))
    assert len(decontam.simhashes(hashes[:3], 5, 1)) == 0


def test_index_finds_all_within_the_radius():
    draw = np.random.default_rng(2)
    prints = draw.integers(0, 1 << 63, 50, dtype=np.uint64)
    index = decontam._index(prints)
    for k in range(50):
        value = int(prints[k])
        for bit in draw.choice(64, decontam.RADIUS, replace=False).tolist():
            value ^= 1 << bit
        near = set()
        for b, (heads, values) in enumerate(index):
            block = value >> (16 * b) & 0xFFFF
            near.update(values[heads[block] : heads[block + 1]].tolist())
        assert k in near


def test_odd_rows_and_no_rows(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(None, prose(9, 30)), (50, prose(9, 30)), (50, prose(9, 30))]
    docs = documents(spark, rows).selectExpr("*", "1 AS item_id", "2 AS start", "3 AS similarity")
    bench = items(spark, [(1, None), (2, ""), (None, prose(9, 30)), (3, prose(9, 30)), (3, prose(9, 30)), (4, "...")])
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, None), (None, 3), (50, None), (50, 3), (50, None), (50, 3)], key=str
    )
    assert decontam.contaminated(docs.where("false"), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.cleaned(docs, bench.where("false")).count() == len(rows)
    assert decontam.cleaned(docs, bench).count() == len(rows) - 3


def test_weights_do_not_depend_on_the_blocks(spark):
    shared, ends = prose(800, 56).rstrip("."), [prose(801 + k, 4).lower() for k in range(3)]
    bench = items(spark, [(1, f"{shared} {ends[0]}"), (2, f"{shared} {ends[1]}")])
    around = [prose(810 + k, 30) for k in range(2)]
    docs = documents(spark, [(k, f"{around[0]} {shared} {end} {around[1]}") for k, end in ((1, ends[2]), (2, ends[0]))])

    def found(size):
        return {(r.doc_id, r.item_id, r.start): round(r.similarity, 9) for r in decontam.contaminated(docs, bench, block_bytes=size).collect()}

    assert sum(1 for own in decontam.blocks(bench, 60) if own) > 1
    # 52 shared shingles weigh a half each, the four of each ending 1.
    assert found(1 << 20) == found(60) == {(2, 1, 30): 1.0}
    assert [r.doc_id for r in decontam.cleaned(docs, bench, block_bytes=60).collect()] == [1]


def edited(draw, own):
    """The words with some changed, left out, put in, or the last part put first."""
    own = list(own)
    for _ in range(draw.randint(1, max(1, len(own) // 36))):
        at, kind = draw.randrange(len(own)), draw.randrange(8)
        if kind < 5:
            own[at] = f"x{draw.randrange(10**6)}"
        elif kind == 5:
            del own[at]
        elif kind == 6:
            own.insert(at, f"x{draw.randrange(10**6)}")
        else:
            own = own[at:] + own[:at]
    return own


def test_every_edited_passage_of_the_threshold_is_found():
    draw, none = random.Random(3), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))
    sizes = [3, 5, 8, 12, 20, 35, 50, 60, 100, 200]
    texts = [[f"w{draw.randrange(20_000)}" for _ in range(n)] for n in sizes]
    block = decontam.Block([(k, " ".join(own)) for k, own in enumerate(texts)], 5, 0.8, none)
    alike = 0
    for turn in range(400):
        item = turn % len(sizes)
        around = [[f"v{draw.randrange(20_000)}" for _ in range(draw.randrange(60))] for _ in range(2)]
        text = " ".join([*around[0], *edited(draw, texts[item]), *around[1]])
        (hashes, _, _, _), = decontam._words(decontam.pa.array([text]))
        n = sizes[item]
        want = max(block.similarity(item, hashes[max(s, 0) : s + n]) for s in range(1 - n, len(hashes)))
        batch = decontam.pa.RecordBatch.from_pydict({"doc_id": [turn], "text": [text]})
        got = {r["item_id"]: r["similarity"] for out in decontam._hits(iter([batch]), block) for r in out.to_pylist()}
        if want >= 0.8:
            alike += 1
            assert abs(got[item] - want) < 1e-9
        else:
            assert item not in got
    assert alike > 150


def template_corpus(shared, own, count, turns, seed):
    """Items that share a template, and documents that hold an item's own part and some of the template."""
    draw = random.Random(seed)
    stock = [f"t{draw.randrange(10**6)}" for _ in range(shared)]
    bench = [(k, [*stock, *(f"o{draw.randrange(10**6)}" for _ in range(own))]) for k in range(count)]
    rows = []
    for turn in range(turns):
        words = bench[turn % count][1]
        start = draw.choice([shared - draw.randint(0, 9), shared - draw.randint(3, 9), draw.randrange(shared)])
        around = [[f"v{draw.randrange(10**6)}" for _ in range(draw.choice([0, 0, 2, 30]))] for _ in range(2)]
        part = words[start:]
        if turn % 4 == 3:
            part = list(part)
            part[draw.randrange(len(part))] = "edit"
        rows.append((turn, " ".join([*around[0], *part, *around[1]])))
    return [(k, " ".join(w)) for k, w in bench], rows


def best_similarity(block, item, text):
    (hashes, _, _, _), = decontam._words(decontam.pa.array([text]))
    n = block.sizes[item]
    return max(block.similarity(item, hashes[max(s, 0) : s + n]) for s in range(1 - n, len(hashes)))


def test_query_finds_all_of_the_threshold_with_templates_under_any_partitioning(spark):
    for shared, own, count in ((70, 30, 20), (70, 20, 20), (40, 15, 25)):
        bench, rows = template_corpus(shared, own, count, 60, shared + own)
        benchmark = items(spark, bench)
        block = decontam.Block(bench, 5, 0.8, decontam.common_shingles(benchmark))
        want = {(k, k % count) for k, text in rows if best_similarity(block, k % count, text) >= 0.8}
        docs = documents(spark, rows)
        first, second = (
            sorted(map(tuple, decontam.contaminated(part, benchmark).collect()))
            for part in (docs.coalesce(1), docs.repartition(5))
        )
        assert first == second
        assert {(d, i) for d, i, *_ in first} >= want and len(want) > 8
        assert all(alike >= 0.8 - 1e-9 for *_, alike in first)


def test_long_items_with_edits_all_over(spark):
    draw = random.Random(8)
    long = [f"w{draw.randrange(10**6)}" for _ in range(2_000)]
    changed = [f"x{k}" if k % 90 == 45 else w for k, w in enumerate(long)]
    docs = documents(spark, [(1, " ".join(changed)), (2, " ".join(long[:1_000])), (3, "a b " + " ".join(long))])
    got = decontam.contaminated(docs, items(spark, [(7, " ".join(long))])).collect()
    assert {(r.doc_id, r.item_id, r.start) for r in got} == {(1, 7, 0), (3, 7, 2)}
