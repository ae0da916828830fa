import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rivulet.llm import suffix_tree as st
from tests.llm.helpers import documents, odd_texts, prose, tokens


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    counts = Counter()
    for i, text in rows:
        if not held_out("" if i is None else i):
            counts.update([*tokens(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = [*tokens(text), None]
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((i, len(own), sum(counts[t] > 0 for t in own), n, score))
    return out


def test_base_score_and_counts(spark):
    rows = list(enumerate(odd_texts() + [prose(k, 100) for k in range(60)]))
    got = {r.doc_id: r for r in st.scored(documents(spark, rows)).collect()}
    for i, n_tokens, n_known, train, score in base(rows):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, train, held_out(i))
        assert math.isclose(r.base_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 1e-9


def chained(seed, n):
    """Words that depend on the one before, and at forks on the two before."""
    draw, out = random.Random(seed), ["a"]
    while len(out) < n:
        last, before = out[-1], out[-2] if len(out) > 1 else ""
        if last == "x":
            out.append({"a": "p", "b": "q"}.get(before, "a"))
        elif last in "ab":
            out.append("x" if draw.random() < 0.8 else draw.choice("abc"))
        else:
            out.append(draw.choice("abcd"))
    return " ".join(out)


def learnt(spark, rows):
    return st.learn(documents(spark, [r for r in rows if not held_out(r[0])]).select("text"))


def test_contexts_raise_held_out_likelihood(spark):
    rows = [(k, chained(k, 200)) for k in range(200)]
    got = st.scored(documents(spark, rows)).collect()
    out = [r for r in got if r.held_out]
    assert out and all(r.score > r.base_score + 10 for r in out)
    tree = learnt(spark, rows)
    assert (np.array(tree.alpha)[tree.deeper[0][1]] != 1).any(), "two-word contexts are retained where the farther word matters"


def test_distributions_sum_to_one(spark):
    rows = [(k, chained(k, 200) + " rare" + str(k)) for k in range(100)]
    tree = learnt(spark, rows)
    width = len(tree.symbols)
    assert width == tree.distinct, "every word is common in so small a corpus"
    unseen = st.ADDED / tree.total
    for node in range(len(tree.alpha)):
        known = (10.0 ** st._log_probability(tree, np.full(width, node), np.arange(width))).sum()
        other = unseen * 10.0 ** st._way_down(tree, np.array([node]))[0]
        assert math.isclose(known + other, 1.0, rel_tol=1e-6)


def test_tasks_agree_with_a_plain_walk(spark):
    rows = [(k, chained(k, 60)) for k in range(150)]
    tree = learnt(spark, rows)
    place = {h: k for k, h in enumerate(tree.symbols.tolist())}
    found = {r.doc_id: r.score for r in st.scored(documents(spark, rows)).collect()}
    for i, text in rows[:20]:
        (_, _, hashes, row), = st._tokens(pa.array([text]))
        symbols = np.array([place.get(h, -1) for h in hashes.tolist()])
        total, begin = 0.0, len(tree.symbols)
        for t, s in enumerate(symbols):
            history = [begin if t == back else symbols[t - back - 1] for back in range(min(t + 1, st.DEPTH))]
            node = int(tree.first[history[0]]) if history[0] >= 0 else 0
            reached = node
            for (keys, nodes), word in zip(tree.deeper, history[1:]):
                at = np.flatnonzero(keys == reached * (begin + 1) + word) if reached and word >= 0 else []
                reached = int(nodes[at[0]]) if len(at) else 0
                node = reached or node
            if s >= 0:
                total += st._log_probability(tree, np.array([node]), np.array([s]))[0]
            else:
                total += st._way_down(tree, np.array([node]))[0] + math.log10(st.ADDED / tree.total)
        assert math.isclose(found[i], total, rel_tol=1e-9)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, None), (None, "a b"), (5, "a b"), (5, "a b"), (5, "c"), (6, "")]
    docs = documents(spark, rows).selectExpr("*", "1 AS key", "2 AS n", "3 AS own", "4 AS row")
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in st.scored(docs).collect())
    assert got == sorted((i or -1, n, known, round(score, 9)) for i, n, known, _, score in base(rows))
    assert st.scored(docs.where("false")).count() == 0
    unlearnt = st.scored(docs.where("doc_id IS NULL")).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9) + 0) for r in unlearnt] == [(0, 0, 0.0)] * 2


def counted(rows):
    """Occurrences of every sequence of up to DEPTH + 1 tokens, from the definition."""
    out = Counter()
    for _, text in rows:
        own = ["<", *tokens(text), None]
        for i in range(len(own)):
            for n in range(1, st.DEPTH + 2):
                if i + n <= len(own):
                    out[tuple(own[i : i + n])] += 1
    return out


def test_contexts_are_those_that_occur_often_enough(spark):
    rows = [r for r in ((k, chained(k, 80)) for k in range(60)) if not held_out(r[0])]
    tree, found = learnt(spark, rows), counted(rows)
    least = tree.least(st.CONTEXT, st.CONTEXT_SHARE)
    pair = max(tree.least(st.PAIR, st.PAIR_SHARE), st.LEAST_PAIR)
    sizes = [int((tree.first > 0).sum()), *(len(keys) for keys, _ in tree.deeper)]
    for depth, size in enumerate(sizes, 1):
        want = {c for c, n in found.items() if len(c) == depth and n >= max(least, pair if depth > 1 else 0) and c[-1] is not None}
        assert size == len(want)
    assert len(sizes) == st.DEPTH


def test_twice_the_corpus_has_more_contexts(spark):
    rows = [(k, chained(k, 80)) for k in range(60)]
    new = [(1000 + k, " ".join(f"n{w}" for w in chained(k, 80).split())) for k in range(60)]
    once, twice = (learnt(spark, own) for own in (rows, rows + new))
    assert len(twice.alpha) > 1.3 * len(once.alpha) and len(twice.pair_keys) > 1.3 * len(once.pair_keys)


def test_children_of_rejected_contexts_are_tested(spark):
    # Words mostly repeat the word two before: the word before alone says nothing about the next one.
    draw, rows = random.Random(5), []
    for k in range(300):
        out = [draw.choice("uv"), draw.choice("uv")]
        while len(out) < 60:
            out.append(out[-2] if draw.random() < 0.9 else draw.choice("uv"))
        rows.append((k, " ".join(out)))
    tree = learnt(spark, rows)
    (_, _, hashes, _), = st._tokens(pa.array(["u v"]))
    singles = [int(tree.first[np.flatnonzero(tree.symbols == h)[0]]) for h in hashes[:2]]
    assert [tree.alpha[k] for k in singles] == [1.0, 1.0], "one word does not diverge"
    keys, nodes = tree.deeper[0]
    children = nodes[np.isin(keys // (len(tree.symbols) + 1), singles)]
    assert (np.array(tree.alpha)[children] != 1.0).sum() >= 4
