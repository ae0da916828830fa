import random

import numpy as np
import pytest

from rivulet.llm import minhash, words
from tests.llm.helpers import VOCABULARY, documents, odd_texts, prose, tokens


def brute(rows, size, threshold=0.8):
    sets = {}
    for doc_id, text in rows:
        own = tokens(text)
        n = min(size, len(own))
        sets.setdefault(doc_id, []).append(set(zip(*(own[k:] for k in range(n)))) if own else set())
    ids = sorted(i for i in sets if i is not None)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(
                x and y and 100 * len(x & y) >= 100 * threshold * len(x | y) for x in sets[a] for y in sets[b]
            ):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {i: root(i) for i in ids}


def near_copies(seed, n, words_, edits):
    draw, base = random.Random(seed), prose(seed, words_).split(" ")
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(len(own))] = draw.choice(VOCABULARY) + "x"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_classes_match_all_pairs(spark, size):
    texts = odd_texts() + [prose(k, 60) for k in range(20)]
    for seed in range(8):
        texts += near_copies(100 + seed, 6, 80, 6)
    texts += [texts[20]] * 30 + ["a b c", "A  b\tC", "c b a"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, rows), shingle=size).collect()}
    want = brute(rows, size)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == {i for i, c in want.items() if i == c}
    for i, text in rows:
        own = tokens(text)
        assert got[i].n_shingles == len(set(zip(*(own[k:] for k in range(min(size, len(own))))))) if own else True


def test_links_beyond_the_smallest_of_a_bucket(spark, monkeypatch):
    """Chains: neighbours are alike, ends are not. With tiny blocks, all block meetings are needed."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    draw, rows = random.Random(5), []
    for chain in range(4):
        own = [f"c{chain}w{k}" for k in range(200)]
        for step in range(14):
            rows.append((draw.randrange(10**6), " ".join(own)))
            own = own[8:] + [f"c{chain}s{step}n{k}" for k in range(8)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), shingle=2).collect()}
    assert got == brute(rows, 2)
    assert len(set(got.values())) == 4


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, None), (7, "x y z u v"), (9, "x y z u v"), (1, "")]
    docs = documents(spark, rows).selectExpr("*", "1 AS u", "2 AS v", "3 AS rep", "4 AS component_id")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted([
        (-1, 1, None, False), (3, 1, 3, True), (3, 1, 3, True), (7, 0, 7, True), (7, 1, 7, True), (9, 1, 7, False),
        (1, 0, 1, True),
    ])
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    kept = minhash.unique_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 7]


def test_signature_agreement_estimates_similarity():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = values[:1250], values[250:]
    both = minhash.signature_rows(np.concatenate([a, b]), np.array([0, 1250]), 400)
    assert abs((both[:, 0] == both[:, 1]).mean() - 1000 / 1500) < 0.06


def test_components_of_a_long_path(spark):
    from rivulet.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 50), (None, 3), (7, 8)], "u long, v long")
    got = components(links).collect()
    assert {(r.u, r.v) for r in got} == {(k, 0) for k in range(1, 41)}
    assert components(links.where("false")).count() == 0
