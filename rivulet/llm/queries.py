"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivulet.llm import (
    decontam, fingerprints, language, lines, minhash, mixing, periods, quality, sharding, spelling, substrings,
    suffix_tree, urls,
)
from rivulet.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_minmax_near_dedup(spark, sf_dir):
    """Classes of documents whose sets of 2-word shingles have a Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2)


@query
def op2_source_mix(spark, sf_dir):
    """What a mix with weights 1, 2, 3 by source takes of every document."""
    rows = mixing.mixture(mixing.measured(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_suffix_tree_scores(spark, sf_dir):
    """Log probability of every document under a probabilistic suffix tree and under single words."""
    return suffix_tree.scored(documents(spark, sf_dir))


@query
def op4_repeated_passages(spark, sf_dir):
    """The documents that lose repeated passages, what goes and what stays."""
    return substrings.repeats_removed(documents(spark, sf_dir))


@query
def op5_line_dedup(spark, sf_dir):
    """Numbers of lines and digest of the kept text of every document."""
    rows = lines.deduplicated(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_benchmark_leaks(spark, sf_dir):
    """The benchmark items that documents contain."""
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op7_url_verdicts(spark, sf_dir):
    """Host, path, rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = urls.judged(pages, urls.host_rules(spark), urls.patterns(spark))
    return rows.select("page_id", "host", "path", "rule", "verdict")


@query
def op8_fingerprints(spark, sf_dir):
    """Fingerprints of every text and its edited text, and how alike they are."""
    return fingerprints.fingerprinted(documents(spark, sf_dir))


@query
def op9_quality(spark, sf_dir):
    """Score and decision of the classifier for every document."""
    docs = documents(spark, sf_dir)
    scored = quality.scored(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "bad_score", "kept")


@query
def op10_hash_tree_shards(spark, sf_dir):
    """Shard and slot of every document, and its shard when there is one more."""
    return sharding.sharded(documents(spark, sf_dir))


@query
def op11_language(spark, sf_dir):
    """Language of every document by naive Bayes over hashed character n-grams."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    learnt = language.learn(rows.where("NOT held_out").select("text", "lang"))
    scored = language.predicted(rows.select("doc_id", "text", "held_out"), learnt)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


@query
def op12_spelling_variants(spark, sf_dir):
    """Words of the corpus with the words one edit away, and the word that each is a variant of."""
    counted = spelling.word_counts(documents(spark, sf_dir))
    return spelling.variants(counted).select("word", "form", "root", "n", "n_near", "form_n")


def with_planted_run(text: Column, doc_id: Column) -> Column:
    """The text, in a tenth of the documents with its last words replaced by repetitions of some of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    # The run's first words as often as they fit; there is no lambda over the words, which would split the text anew.
    often = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), often)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), planted).otherwise(text)


@query
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words of every document, some of them planted, and digests of them and of the collapsed text."""
    docs = documents(spark, sf_dir)
    rows = periods.repetitions(docs.select("doc_id", with_planted_run(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")
    )))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = rows.withColumn("best", longest)
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.shorter")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
