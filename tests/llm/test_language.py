import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from rivulet.llm import language, words
from rivulet.llm.queries import QUERIES
from tests.llm.helpers import documents, odd_texts

PARTS = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ch"], "cc": ["é", "eau", "où"]}


def corpus(count=240, seed=2):
    draw, rows = random.Random(seed), []
    for k in range(count):
        lang = draw.choice(sorted(PARTS))
        text = " ".join("".join(draw.choices(PARTS[lang], k=3)) for _ in range(draw.randint(1, 30)))
        rows.append((k, text, lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def predict(docs, model):
    return language.predicted(docs.selectExpr("*", "false AS held_out"), model)


def plain_grams(text):
    """n-grams by the definition: lower-case A-Z, runs of white space as one blank."""
    out, last = [], False
    for c in text:
        blank = c in " \t\n\x0b\f\r"
        if not (blank and last):
            out.append(" " if blank else c.lower() if "A" <= c <= "Z" else c)
        last = blank
    return Counter("".join(out[i : i + n]) for n in range(1, language.LONGEST + 1) for i in range(len(out) - n + 1))


def test_grams_are_those_of_the_text():
    import pyarrow as pa

    texts = ["Ab  c\n\nÄ", "", "x", "日本\U0001f600 é", "the cat"]
    for _, _, data, offsets in words.slices(pa.array(texts)):
        number, row = language.grams(data, offsets, 1 << 20)
        for k, text in enumerate(texts):
            own = Counter(Counter(number[row == k].tolist()).values())
            assert own == Counter(plain_grams(text).values())


def test_scores_follow_bayes(spark):
    rows = corpus()
    model = language.learn(table(spark, rows[:200]), bins=1 << 14)
    total = {lang: Counter() for lang in PARTS}
    for _, text, lang in rows[:200]:
        total[lang].update(plain_grams(text))
    seen = Counter(lang for _, _, lang in rows[:200])
    got = {r.doc_id: r for r in predict(table(spark, rows[200:]), model).collect()}
    for k, text, _ in rows[200:]:
        logs = {}
        for lang, own in total.items():
            size = sum(own.values()) + language.ADDED * (1 << 14)
            logs[lang] = math.log(seen[lang] / 200) + sum(
                n * math.log((own[g] + language.ADDED) / size) for g, n in plain_grams(text).items()
            )
        top = max(logs.values())
        odds = {lang: math.exp(x - top) for lang, x in logs.items()}
        assert got[k].lang_pred == max(odds, key=odds.get)
        # Grams that share a bin change a posterior a little.
        assert abs(got[k].score - 1 / sum(odds.values())) < 1e-2


def test_partitioning_does_not_matter(spark):
    rows = corpus(60)
    models = [language.learn(table(spark, rows).repartition(n)) for n in (1, 7)]
    assert models[0].languages == models[1].languages
    assert np.array_equal(models[0].logs, models[1].logs) and np.array_equal(models[0].prior, models[1].prior)


def test_undetermined_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = corpus(40) + [(900, None, "aa"), (901, "12 34 !?", "bb"), (902, "text", None), (902, "text", None)]
    docs = table(spark, rows).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS lettered")
    model = language.learn(docs)
    assert model.languages == sorted(PARTS) and abs(np.exp(model.prior).sum() - 1) < 1e-12
    got = [r for r in predict(docs, model).collect() if r.doc_id >= 900]
    assert [(r.lang_pred, r.score) for r in got[:2]] == [("und", 0.0)] * 2 and len(got) == 4
    assert all(r.lang_pred in PARTS and 0 <= r.score <= 1 for r in got[2:])
    assert predict(docs.where("false"), model).collect() == []
    nothing = language.learn(docs.where("lang IS NULL"))
    assert {(r.lang_pred, r.score) for r in predict(docs, nothing).collect()} == {("und", 0.0)}


def test_odd_texts_and_many_languages(spark):
    docs = documents(spark, [(k, t) for k, t in enumerate(odd_texts())])
    many = table(spark, [(k, f"word{k} {'xyz' * (k % 5)}", f"l{k:03d}") for k in range(300)])
    model = language.learn(many)
    assert model.logs.size <= language.LARGEST_MATRIX and len(model.languages) == 300
    got = predict(docs, model).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)


def test_query_on_held_out_documents(spark, sf_dir):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = QUERIES["op11_language"](spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held) > 0
