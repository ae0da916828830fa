import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from rivulet.llm import oracles, spelling
from rivulet.llm.queries import QUERIES
from tests.llm.helpers import documents, odd_texts


def counts(rows, least_length=5, least_count=3, drop_every=97):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    for w in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] += (forms[w], words[forms[w]] if forms[w] else None, root)
    return out


def found(spark, words, **options):
    counted = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    rows = spelling.variants(counted, **options).collect()
    assert len(rows) == len(words)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def vocabulary(seed, size, parts=("th", "ea", "er", "on", "ti", "é", "st", "a", "nd", "ÿo")):
    draw, out = random.Random(seed), set()
    while len(out) < size:
        word = "".join(draw.choices(parts, k=draw.randint(2, 6)))
        for _ in range(draw.choice([0, 0, 1, 1])):
            k = draw.randrange(len(word) + 1)
            word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("aeiounß") + word[k:]])
        if len(word) >= 5:
            out.add(word)
    return {w: draw.choice([3, 4, 9, 20, 70]) for w in sorted(out)}


@pytest.mark.parametrize("frequent", [1, 8, 64, 10_000])
def test_every_near_pair_whatever_the_dictionary(spark, frequent):
    words = vocabulary(frequent, 900)
    assert found(spark, words, frequent=frequent) == brute(words)


def test_long_lists_in_blocks(spark):
    words = vocabulary(2, 500)
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {(r.u, r.v) for r in spelling.near_pairs(counted, block=7).collect()}
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert {frozenset(p) for p in pairs} == want and len(pairs) == len(want)


def test_random_letters_and_all_lengths(spark):
    draw, words = random.Random(9), {}
    for n in [*range(3, 40), 200, 5_000]:
        for _ in range(4):
            w = "".join(draw.choices("abcàÿ", k=n))
            k = draw.randrange(n)
            for x in (w, w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "y" + w[k + 1 :]):
                if len(x) >= 3:
                    words[x] = draw.randint(1, 50)
    assert found(spark, words) == brute(words)


def test_safe_grams_are_shared_with_every_word_one_edit_away():
    import numpy as np

    words = list(vocabulary(4, 400))
    spread = Counter()
    for w in words:
        for _, symbols in spelling._by_length(pa_words([w])):
            for h in spelling._hashed(symbols, spelling.longest_gram(len(w))).values():
                spread.update(h.ravel().tolist())
    frequent = np.array(sorted(h for h, n in spread.items() if n > 3), dtype=np.uint64)

    def grams(w, size):
        (_, symbols), = spelling._by_length(pa_words([w]))
        d = spelling.Decomposed(symbols, spelling.longest_gram(size), frequent)
        places = np.flatnonzero(d.kept[0])
        ahead = {(int(d.hash[0, p]), int(p)) for p in places}
        behind = {(int(d.hash[0, p]), int(len(w) + 2 - p - d.size[0, p])) for p in places}
        return ahead, behind, int(d.safe[0])

    draw = random.Random(1)
    for w in words:
        k = draw.randrange(len(w))
        for x in (w[:k] + "q" + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + draw.choice("thea") + w[k:]):
            if x != w:
                (a, b, safe), (c, d, other) = grams(w, len(w)), grams(x, len(w))
                assert len(a & c) + len(b & d - {g for g in b & d if g in a & c}) >= max(safe, other) >= 1


def pa_words(words):
    import pyarrow as pa

    return pa.array(words)


def test_counts_match_plain_python(spark):
    draw = random.Random(7)
    rows = [(k, " ".join(draw.choices(["Thorn", "thorn", "ÄRGER", "ärger", "naïve", "x1word", "Straße", "ab"], k=40)))
            for k in range(300)]
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts())] + [(None, "Thorn " * 5), (None, None)]
    rows += [(5, "y" * 300 + " " + "y" * 300 + " " + "y" * 300)]
    for options in ({}, {"drop_every": 0}, {"drop_every": 2, "least_length": 3, "least_count": 1}):
        docs = documents(spark, rows).selectExpr("*", "1 AS word", "2 AS n")
        got = {r.word: r.n for r in spelling.word_counts(docs, **options).collect()}
        assert got == counts(rows, **options)


def test_roots_chains_ties_nulls_and_no_rows(spark):
    words = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6}
    got = found(spark, words)
    assert got == brute(words)
    assert got["aaaaa"][4] == "bbbbb" and got["zzzzz"][2] == "zzzzx"
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).collect() == []
    odd = spark.createDataFrame([(None, 3), ("", 4), ("ab", 5)], "word string, n long")
    assert {(r.word, r.n_near, r.root) for r in spelling.variants(odd).collect()} == {
        (None, 0, None), ("", 0, ""), ("ab", 0, "ab")
    }


def test_query_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    columns = "word form root n n_near form_n".split()
    want = sorted(db.execute(oracles.ORACLES["op12_spelling_variants"]).fetchall())
    assert sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, sf_dir).select(columns).collect())) == want
