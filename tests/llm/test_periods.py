import hashlib
import random
import zlib

import duckdb
import numpy as np

from rivulet.llm import oracles, periods
from rivulet.llm.queries import QUERIES
from tests.llm.helpers import documents, odd_texts


def words_of(text):
    return (text or "").encode().split()


def brute(words, least=12):
    """Every period at every place, straight from the definition."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


def texts(seed=3, count=250):
    draw, out = random.Random(seed), []
    for _ in range(count):
        own = [f"w{draw.randrange(draw.choice([1, 2, 4, 60]))}" for _ in range(draw.randint(0, 50))]
        if own and draw.random() < 0.6:
            at, p = draw.randrange(len(own)), draw.randint(1, 9)
            unit = (own[at:] + own)[:p]
            own[at:at] = (unit * draw.randint(2, 9))[: draw.randint(3, 60)]
        out.append(draw.choice([" ", "\n", " \t"]).join(own))
    return out


def found(docs, **options):
    return {
        r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed)
        for r in periods.repetitions(docs, **options).collect()
    }


def test_matches_the_definition_on_words_alone():
    for least in (2, 7, 12):
        for text in texts(5, 120):
            own = words_of(text)
            codes = np.array([sorted(set(own)).index(w) for w in own], dtype=np.int64)
            got = periods.runs(codes, np.full(len(own), len(own)), least)
            assert list(zip(*(x.tolist() for x in got))) == brute(own, least)


def test_matches_the_definition_over_many_texts(spark):
    rows = list(enumerate(texts() + odd_texts()))
    got = found(documents(spark, rows).repartition(3))
    for k, text in rows:
        own = words_of(text)
        runs = brute(own) if len(own) < 400 else got[k][1]
        assert got[k] == (len(own), runs, collapsed(own, runs))


def test_texts_do_not_run_into_each_other(spark):
    rows = [(k, "a b c a b c a b c") for k in range(5)]
    assert all(runs == [] for _, runs, _ in found(documents(spark, rows)).values())


def test_long_and_highly_periodic_texts(spark):
    rows = [
        (1, "same " * 60_000), (2, " ".join(f"u{k % 7}" for k in range(40_000))),
        (3, " ".join(f"own{k} one two three four five six seven eight" for k in range(4_000))),
        (4, "a b " * 5_000 + "c " + "a b " * 5_000),
    ]
    got = found(documents(spark, rows))
    assert got[1] == (60_000, [(0, 60_000, 1)], "same")
    assert got[2] == (40_000, [(0, 40_000, 7)], "u0 u1 u2 u3 u4 u5 u6")
    assert got[3][1] == []
    assert got[4][1:] == ([(0, 10_000, 2), (10_001, 10_000, 2)], "a b c a b")


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(None, "x " * 12), (1, None), (1, None), (2, "x " * 11)]
    docs = documents(spark, rows).selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS n_words")
    got = sorted(map(str, periods.repetitions(docs).collect()))
    assert len(got) == 4 and sum("length=12" in x for x in got) == 1
    assert periods.repetitions(docs.where("false")).collect() == []


def test_query_plants_and_digests(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        own, h = words_of(text), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and own:
            g = h // 10
            a = g % len(own)
            p = 1 + (len(own) - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(len(own))]
        if len(own) > 1_500:
            continue
        runs, r = brute(own), got[doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(own, runs).encode()).hexdigest()


def test_sql_gives_the_same(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    want = sorted(db.execute(oracles.ORACLES["op13_periodic_runs"]).fetchall())
    assert sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, sf_dir).select(columns).collect())) == want
