import random

import numpy as np

from rivulet.llm import quality
from tests.llm.helpers import VOCABULARY, documents, odd_texts, prose

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["oaf", "cretin", "knave", "lout"]


def corpus(seed=1, n=900):
    """Prose, junk of several kinds and toxic prose; labels for some."""
    draw, rows, bad = random.Random(seed), [], {}
    for k in range(n):
        text, kind = prose(seed * 10_000 + k, draw.randint(30, 150)), k % 10
        words = text.split(" ")
        if kind == 0:
            text = " ".join(w + draw.choice(["***", "&&&", "$$$"]) for w in words)
        elif kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2:
            text = " ".join(words[:15] * 8)
        elif kind == 3:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
            text = " ".join(words)
        rows.append((k, text))
        bad[k] = kind
    labels = [(k, int(bad[k] > 2), int(bad[k] == 3)) for k in range(n) if draw.random() < 0.4]
    return rows, bad, labels


def test_catches_junk_and_toxic_and_keeps_the_rest(spark):
    rows, bad, labels = corpus()
    got = quality.scored(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    labelled = {i for i, _, _ in labels}
    held = [r for r in got if r.doc_id not in labelled]
    assert len(got) == len(rows)
    caught = np.mean([not r.kept for r in held if bad[r.doc_id] <= 3])
    kept = np.mean([r.kept for r in held if bad[r.doc_id] > 3])
    assert caught > 0.95 and kept > 0.97
    assert all(r.kept == (r.bad_score < quality.THRESHOLD) for r in got)


def test_expectation_maximisation_recovers_accuracies():
    draw = np.random.default_rng(5)
    truth = draw.random(20_000) < 0.3
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([
        np.where(draw.random(len(truth)) < 0.2, quality.NONE,
                 np.where(draw.random(len(truth)) < p, truth, ~truth)) for p in right
    ], axis=1)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.agreement(patterns, counts.astype(float))[place.reshape(-1)]
    by_majority = (votes == quality.BAD).sum(axis=1) > (votes == quality.GOOD).sum(axis=1)
    assert ((posterior > 0.5) == truth).mean() > max(0.94, (by_majority == truth).mean())


def test_statistics_of_plain_texts():
    texts = ["one two three", "a*** b&&& c", "LOUD WORDS here!!", "x x x y", "", "a b c d a b c d"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    shares, hits, _, _ = quality.statistics(data, offsets, np.zeros(0, dtype=np.uint64))
    assert shares["symbols"].round(2).tolist() == [0, 0.67, 0.33, 0, 0, 0]
    assert shares["shouting"].round(2).tolist() == [0, 0, 0.67, 0, 0, 0]
    assert shares["stutter"].round(2).tolist() == [0, 0, 0, 0.5, 0, 0]
    assert shares["repetition"].round(2).tolist() == [0, 0, 0, 0, 0, 0.33]
    assert hits.tolist() == [0] * 6


def test_reruns_agree(spark):
    rows, _, labels = corpus(seed=2, n=200)
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    first = sorted((r.doc_id, r.bad_score) for r in quality.scored(docs, marks).collect())
    again = sorted((r.doc_id, r.bad_score) for r in quality.scored(docs.repartition(5), marks.repartition(3)).collect())
    assert np.allclose([s for _, s in first], [s for _, s in again], atol=1e-6)


def test_odd_rows_labels_and_no_rows(spark):
    rows, _, labels = corpus(seed=3, n=200)
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts())] + [(None, "a b c"), (None, None), (0, rows[0][1])]
    labels += [(None, 0, 1), (5, None, None), (5, 1, 0), (10**9, 0, 0), (1001, None, 1), (1000, 1, None)]
    docs = documents(spark, rows).selectExpr("*", "1 AS bad", "2 AS word", "3 AS kept", "4 AS bad_score", "5 AS toxic")
    got = quality.scored(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == [*(c for c in docs.columns if c not in ("kept", "bad_score")), "bad_score", "kept"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.bad_score <= 1 for r in out)
    zero = [r.bad_score for r in out if r.doc_id == 0]
    assert len(zero) == 2 and zero[0] == zero[1]
    none = spark.createDataFrame([], LABELS)
    assert quality.scored(docs.where("false"), none).count() == 0
    alone = quality.scored(docs, none).where("doc_id < 200").collect()
    assert np.mean([not r.kept for r in alone if r.doc_id % 10 <= 2]) > 0.9
    assert np.mean([r.kept for r in alone if r.doc_id % 10 > 2]) > 0.9
