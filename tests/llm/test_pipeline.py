import random
from collections import Counter

import corpus_pipeline
from rivulet.llm import mixing, sharding
from tests.llm.helpers import prose, tokens
from tests.llm.test_minhash import brute, near_copies
from tests.llm.test_quality import corpus as judged_corpus
from tests.llm.test_quality import LABELS


def inputs(spark, folder):
    draw = random.Random(6)
    rows, bad, labels = judged_corpus(seed=4, n=600)
    texts = dict(rows)
    bench = [(k, prose(8000 + k, 40)) for k in range(5)]
    planted = set()
    for k in range(5):
        doc = 10 * k + 5
        texts[doc] += " " + bench[k][1]
        planted.add(doc)
    for seed in range(4):
        for text in near_copies(9000 + seed, 5, 120, 2):
            texts[len(texts)] = text
    full = [(i, t, "en", f"s{draw.randrange(4)}", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return texts, bad, planted


def test_every_stage_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    texts, bad, planted = inputs(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{len(seen)}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard"])
        assert all(texts[r.doc_id] == r.text for r in docs.collect())
    judged, unique, clean, mixed, sharded = map(Counter, seen)
    good = {i for i in texts if bad.get(i, 9) > 3}
    assert len(good - set(judged)) <= 0.03 * len(good) and len(set(judged) - good) <= 0.05 * (len(texts) - len(good))
    classes = brute([(i, texts[i]) for i in judged], 5)
    assert set(unique) == {i for i, c in classes.items() if i == c} and max(unique.values()) == 1
    assert set(clean) == set(unique) - planted
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    total = sum(len(tokens(texts[i])) for i in clean)
    assert abs(sum(n * len(tokens(texts[i])) for i, n in mixed.items()) - total) < 0.05 * total
    assert sharded == mixed
    tree = {r.doc_id: r.shard for r in sharding.assigned(docs.drop("shard")).collect()}
    assert all(r.shard == tree[r.doc_id] for r in docs.collect())


def test_run_over_no_rows(spark, tmp_path):
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                          ("benchmark", "item_id long, text string"), ("labels", LABELS)):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns[-1] == "shard"


def test_stages_carry_odd_rows_and_extra_columns(spark, tmp_path):
    inputs(spark, str(tmp_path))
    rows = [(None, None, None), (None, "a b", None), (1, "", "s"), (1, prose(1, 30), "s"), (2, prose(1, 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS kept", "2 AS bad_score", "3 AS u", "4 AS v", "5 AS rep", "6 AS taken", "7 AS copies", "8 AS size"
    )
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(got.columns)
        assert got.count() >= 3
    assert mixing.mixed(docs).where("size <> 8").count() == 0


CLASHING = [
    "_own", "_first", "_shard_region", "_shard_rack", "_copies", "_equal", "_turn", "_taken", "_copy", "_id", "bad_score",
    "kept", "row", "id", "own", "origin", "first", "turn", "copy", "equal", "component_id", "n_shingles", "rep", "key",
]


def test_stages_leave_columns_of_any_name_as_they_are(spark, tmp_path):
    inputs(spark, str(tmp_path))
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, prose(50, 30), None), (9_999, None, "s1")], plain.schema)
    values = [f"coalesce(doc_id, -1) * 100 + {k} AS `{name}`" for k, name in enumerate(CLASHING)]
    docs = plain.unionByName(odd).selectExpr("*", *values, "'x' AS `a.b`")
    want = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        columns = [c for c in got.columns if c != "shard"]
        assert columns == docs.columns, name
        rows = got.collect()
        assert len(rows) > 200, name
        for r in rows:
            assert all(r[c] == want[r.doc_id, r.text][c] for c in columns), name
