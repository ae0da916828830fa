"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on every document: share of symbol words, of shouted words, of words that
repeat the one before, of repeated shingles, words of a lexicon of toxic words, and the annotators of the labels table
where they labelled the document. Expectation-maximisation over the counts of vote patterns (at most 3 per labeller to
the power of their number) estimates how each labeller votes on bad and on good documents. The posterior of its votes
labels a document, and the posterior labels train a linear scorer over hashed words and statistics, which alone decides:
it needs no annotator and scores every document.

Bounds: the lexicon is learnt from about ``LEXICON_SAMPLE`` labelled documents and the scorer from about ``SAMPLE``
documents, both drawn by a hash of the id. Vote counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rivulet.llm import words
from rivulet.llm.components import filtered, written

LEXICON_SAMPLE = 40_000
SAMPLE = 20_000
LEXICON_SIZE = 5_000
LEAST_EVIDENCE = 25.0
HASHED = 1 << 18
ROUNDS = 50
EPOCHS = 150
RATE = 0.5
DECAY = 1e-5
WORD_VALUE = 0.2
THRESHOLD = 0.5
ANCHOR = 5
SEED = 9
GOOD, BAD, NONE = 0, 1, 2
LABELLERS = ("symbols", "shouting", "stutter", "repetition", "lexicon", "annotators")
# From here on a share counts as bad, up to here as good, in between the labeller does not vote.
LIMITS = {"symbols": (0.02, 0.1), "shouting": (0.02, 0.1), "stutter": (0.05, 0.2), "repetition": (0.2, 0.5)}
LEAST_TOXIC = 2
TOXIC_SHARE = 0.001
EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8])
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*|~^<>{}"]] = True
_TAILS = np.zeros(256, dtype=bool)
_TAILS[ord("!")] = True


@dataclass
class Scorer:
    """All that scoring needs: the lexicon's word hashes, the weights and the intercept."""

    lexicon: np.ndarray
    weights: np.ndarray
    intercept: float


def _share(part: np.ndarray, row: np.ndarray, size: int, total: np.ndarray) -> np.ndarray:
    return np.bincount(row, part, size) / np.maximum(total, 1)


def _repeats(hashes: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """How many shingles of three words of each row occurred in it before."""
    if len(hashes) < 3:
        return np.zeros(size)
    own = words.combine([hashes[:-2], hashes[1:-1], hashes[2:]])
    inside = row[2:] == row[:-2]
    own, at = own[inside], row[:-2][inside]
    order = np.lexsort((own, at))
    again = (own[order][1:] == own[order][:-1]) & (at[order][1:] == at[order][:-1])
    return np.bincount(at[order][1:], again, size)


def statistics(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray):
    """Shares of each labeller but the annotators, numbers of toxic words, bare words and their rows."""
    size = len(offsets) - 1
    starts, ends, first = words.spans(data, offsets)
    total = np.diff(first)
    row = np.repeat(np.arange(size), total)
    tail = data[ends - 1] if len(ends) else data[:0]
    second = data[np.maximum(ends - 2, 0)] if len(ends) else data[:0]
    odd = _SYMBOL[tail] | (_TAILS[tail] & _TAILS[second])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    large = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    loud = (large[ends] - large[starts] >= 2) & (small[ends] == small[starts])
    hashes = words.hashes(words.lower_ascii(data), starts, ends)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    bare, bare_first = words.word_hashes(data, offsets, words.PUNCTUATION)
    bare_row = np.repeat(np.arange(size), np.diff(bare_first))
    toxic = np.zeros(len(bare), dtype=bool)
    if len(lexicon) and len(bare):
        at = np.minimum(np.searchsorted(lexicon, bare), len(lexicon) - 1)
        toxic = lexicon[at] == bare
    hits = np.bincount(bare_row, toxic, size)
    shares = {
        "symbols": _share(odd, row, size, total), "shouting": _share(loud, row, size, total),
        "stutter": _share(same, row, size, total),
        "repetition": _repeats(hashes, row, size) / np.maximum(total - 2, 1),
        "lexicon": hits / np.maximum(np.diff(bare_first), 1),
    }
    return shares, hits, bare, bare_row


def votes(shares: dict[str, np.ndarray], hits: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' votes: GOOD, BAD or NONE."""
    out = {}
    for name, (low, high) in LIMITS.items():
        out[name] = np.where(shares[name] >= high, BAD, np.where(shares[name] <= low, GOOD, NONE))
    toxic = (hits >= LEAST_TOXIC) & (shares["lexicon"] >= TOXIC_SHARE)
    out["lexicon"] = np.where(toxic, BAD, np.where(hits == 0, GOOD, NONE))
    return out


def features(shares: dict[str, np.ndarray], hits: np.ndarray, bare: np.ndarray, row: np.ndarray, size: int):
    """Hashed features: row, index, value. A text's words weigh ``WORD_VALUE`` together (as a vector), each statistic 1:
    words are so many that the scorer could otherwise tell its sample apart by them."""
    order = np.lexsort((bare, row))
    bare, row = bare[order], row[order]
    new = np.ones(len(bare), dtype=bool)
    new[1:] = (bare[1:] != bare[:-1]) | (row[1:] != row[:-1])
    own, at = (bare[new] % np.uint64(HASHED)).astype(np.int64), row[new]
    number = np.bincount(at, minlength=size)
    value = (WORD_VALUE / np.sqrt(np.maximum(number, 1)))[at]
    rows, indexes, values = [at], [own], [value]
    steps = {name: np.searchsorted(EDGES, share, side="left") for name, share in shares.items()}
    steps["hits"] = np.minimum(hits.astype(np.int64), 8)
    for k, (name, step) in enumerate(sorted(steps.items())):
        key = words.mix(np.uint64(1000 * (k + 1)) + step.astype(np.uint64))
        rows.append(np.arange(size))
        indexes.append((key % np.uint64(HASHED)).astype(np.int64))
        values.append(np.ones(size))
    return np.concatenate(rows), np.concatenate(indexes), np.concatenate(values)


def agreement(
    patterns: np.ndarray, counts: np.ndarray, balance: float | None = None, rounds: int = ROUNDS
) -> np.ndarray:
    """Posterior probability of bad of each vote pattern, by expectation-maximisation.

    Votes are independent given the class; each labeller has its own probabilities of voting bad, good or nothing on
    bad and on good documents. The start takes a pattern with a vote for bad as likely bad. ``balance`` fixes the share
    of bad documents; without it, it is estimated too, which takes labellers that often judge the same documents.
    """
    bad = np.where((patterns == BAD).any(axis=1), 0.9, 0.05)
    for _ in range(rounds):
        prior = (counts @ bad + 1) / (counts.sum() + 2) if balance is None else balance
        odds = np.full(len(patterns), np.log(prior / (1 - prior)))
        for k in range(patterns.shape[1]):
            for vote in (GOOD, BAD, NONE):
                mine = patterns[:, k] == vote
                if_bad = (counts[mine] @ bad[mine] + 0.1) / (counts @ bad + 0.3)
                if_good = (counts[mine] @ (1 - bad[mine]) + 0.1) / (counts @ (1 - bad) + 0.3)
                odds[mine] += np.log(if_bad / if_good)
        bad = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return bad


def posterior_labels(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of each pattern, with the annotators' share of bad documents as balance.

    Labelled documents count ``ANCHOR`` times in the estimates, for there the class is hardly in doubt. Without
    annotators nothing ties faults that never come together to one class; then a vote for bad decides.
    """
    by_annotator = patterns[:, LABELLERS.index("annotators")]
    known = counts[by_annotator != NONE].sum()
    if not known:
        return agreement(patterns, counts, rounds=0)
    balance = float(np.clip(counts[by_annotator == BAD].sum() / known, 0.001, 0.999))
    return agreement(patterns, np.where(by_annotator != NONE, ANCHOR, 1) * counts, balance)


def trained(rows: np.ndarray, indexes: np.ndarray, values: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities as labels, by AdaGrad over all rows; weights and intercept."""
    order = np.argsort(rows, kind="stable")
    rows, indexes, values = rows[order], indexes[order], values[order]
    # Weight of the rarer class, so that it counts as much as the other.
    share = min(max(target.mean(), 0.01), 0.99) if len(target) else 0.5
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    used, place = np.unique(indexes, return_inverse=True)
    w, b, sum_w, sum_b = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(EPOCHS if len(target) else 0):
        z = np.bincount(rows, w[place] * values, len(target)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        grad = np.bincount(place, error[rows] * values, len(used)) + DECAY * w
        sum_w += grad**2
        sum_b += error.sum() ** 2
        w -= RATE * grad / np.sqrt(sum_w)
        b -= RATE * error.sum() / np.sqrt(sum_b)
    out = np.zeros(HASHED, dtype=np.float32)
    out[used] = w
    return out, float(b)


def probability(scorer: Scorer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability that each row is bad."""
    size = len(offsets) - 1
    shares, hits, bare, row = statistics(data, offsets, scorer.lexicon)
    rows, indexes, values = features(shares, hits, bare, row, size)
    z = np.bincount(rows, scorer.weights[indexes] * values, size) + scorer.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _share_of(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` of the rows, drawn by a hash of the key; all of them if they are no more."""
    number = rows.count()
    if number <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 30)) < int(bound / number * (1 << 30)))


def _bare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words with its mark, and its smallest hash of three words, which copies and most near copies
    share and hardly any other texts do."""
    for batch in batches:
        for low, high, data, offsets in words.slices(batch.column("text")):
            hashes, first = words.word_hashes(data, offsets, words.PUNCTUATION)
            row = np.repeat(np.arange(high - low), np.diff(first))
            # Texts of fewer words go by the sequence as far as it reaches.
            ahead = [np.where(np.append(row[k:], [-1] * min(k, len(row))) == row, np.roll(hashes, -k), 0) for k in range(3)]
            kin = np.full(high - low, np.iinfo(np.uint64).max, dtype=np.uint64)
            three = words.combine([part.astype(np.uint64) for part in ahead])
            whole = np.append(row[2:], [-1] * min(2, len(row))) == row
            whole |= (np.diff(first) < 3)[row]
            np.minimum.at(kin, row[whole], three[whole])
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            hashes, row = hashes[new], row[new]
            toxic = batch.column("toxic").slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.signed(hashes)), toxic.take(pa.array(row)), pa.array(words.signed(kin[row]))],
                ["word", "toxic", "kin"],
            )


def lexicon(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Hashes of words that occur in significantly more toxic than other labelled documents.

    The measure is the log-likelihood ratio of a word's documents between the classes; what chance gives among
    millions of words stays below ``LEAST_EVIDENCE``. Copies and near copies count as one document: else every rare
    word of a toxic text that is copied often would seem toxic.
    """
    chosen = _share_of(labels.where("toxic IS NOT NULL"), "doc_id", LEXICON_SAMPLE)
    rows = docs.select("doc_id", "text").join(chosen.select("doc_id", "toxic"), "doc_id")
    found = rows.select("text", "toxic").mapInArrow(_bare_words, "word long, toxic boolean, kin long").distinct()
    found = written(found, "labelled-words")
    numbers = found.select("kin", "toxic").distinct().agg(F.sum(F.col("toxic").cast("long")), F.count("*")).first()
    toxic, other = float(numbers[0] or 0), float(numbers[1] - (numbers[0] or 0))
    if not toxic or not other:
        return np.zeros(0, dtype=np.uint64)
    counted = found.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("x"), F.count("*").alias("n"))
    expected = F.col("n") * (toxic / (toxic + other))
    rest = F.greatest(F.col("n") - F.col("x"), F.lit(0.5))
    evidence = 2 * (
        F.col("x") * F.log(F.col("x") / expected) + rest * F.log(rest / F.greatest(F.col("n") - expected, F.lit(1e-9)))
    )
    found = counted.where((F.col("x") >= 3) & (F.col("x") > 3 * expected)).withColumn("evidence", evidence).where(
        F.col("evidence") >= LEAST_EVIDENCE
    ).orderBy(F.desc("evidence"), "word").limit(LEXICON_SIZE).toArrow()
    return np.sort(found["word"].to_numpy().view(np.uint64))


VOTED = "doc_id long, " + ", ".join(f"{name} int" for name in LABELLERS[:-1])


def _voted(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in words.slices(batch.column("text")):
            shares, hits, _, _ = statistics(data, offsets, known)
            own = votes(shares, hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low).cast(pa.int64()),
                 *(pa.array(own[name].astype(np.int32)) for name in LABELLERS[:-1])],
                ["doc_id", *LABELLERS[:-1]],
            )


def _trained(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, targets, size = [], [], 0
    for batch in batches:
        target = batch.column("bad").to_numpy(zero_copy_only=False)
        for low, high, data, offsets in words.slices(batch.column("text")):
            shares, hits, bare, row = statistics(data, offsets, known)
            rows, indexes, values = features(shares, hits, bare, row, high - low)
            parts.append((rows + size, indexes.astype(np.int32), values.astype(np.float32)))
            targets.append(target[low:high])
            size += high - low
    none = np.zeros(0)
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [none.astype(int), none.astype(int), none]
    weights, intercept = trained(*columns, np.concatenate(targets) if targets else none)
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights.tobytes()], pa.binary()), pa.array([intercept])], ["weights", "intercept"]
    )


def judged_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id: whether any annotator found it bad (of low quality or toxic), and toxic."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad"),
        F.bool_or(F.col("toxic") == 1).alias("toxic"),
    )


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer for these documents, with the labels of those that have any."""
    spark = docs.sparkSession
    annotated = judged_labels(labels)
    known = spark.sparkContext.broadcast(lexicon(docs, annotated))
    voted = docs.select("doc_id", "text").mapInArrow(lambda batches: _voted(batches, known.value), VOTED)
    mark = F.when(F.col("bad"), BAD).when(~F.col("bad"), GOOD).otherwise(NONE).alias("annotators")
    voted = written(
        voted.join(annotated.select("doc_id", "bad"), "doc_id", "left").select("doc_id", *LABELLERS[:-1], mark), "votes"
    )
    patterns = voted.groupBy(*LABELLERS).count().toArrow().to_pandas().sort_values(list(LABELLERS))
    table = patterns[list(LABELLERS)].to_numpy()
    counts = patterns["count"].to_numpy().astype(float)
    posterior = posterior_labels(table, counts) if len(table) else np.zeros(0)
    key = F.concat_ws("", *LABELLERS)
    bad = F.element_at(F.create_map(*(
        F.lit(x) for row, p in zip(table.tolist(), posterior.tolist()) for x in ("".join(map(str, row)), p)
    )), key) if len(table) else F.lit(0.0)
    sample = _share_of(voted.where("doc_id IS NOT NULL"), "doc_id", SAMPLE).select("doc_id", bad.alias("bad"))
    # Sorted, so that the sums over the sample are the same in every run.
    rows = docs.select("doc_id", "text").join(sample.distinct(), "doc_id").repartition(1).sortWithinPartitions(
        "doc_id", "text"
    )
    model = rows.mapInArrow(
        lambda batches: _trained(batches, known.value), "weights binary, intercept double"
    ).first()
    if model is None:
        return Scorer(known.value, np.zeros(HASHED, dtype=np.float32), -1.0)
    return Scorer(known.value, np.frombuffer(bytes(model[0]), dtype=np.float32), model[1])


def _scores(scorer: Scorer, column: pa.Array) -> np.ndarray:
    own = [np.zeros(0)]
    for _, _, data, offsets in words.slices(column):
        own.append(probability(scorer, data, offsets))
    return np.concatenate(own)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with bad_score (probability of being bad, double) and kept (boolean) added.

    Documents with no rows of labels, null or empty texts (which no labeller finds bad) and null doc_ids are scored
    like any other. Repeated rows each give a row, with equal scores. Labels may repeat or lack documents; null
    quality and toxic say nothing bad. Without labels the heuristics alone train the scorer. Columns named bad_score or
    kept are replaced; all others are carried. No rows give no rows.
    """
    docs = docs.drop("bad_score", "kept")
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(scorer.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array(score < threshold)],
                [*batch.schema.names, "bad_score", "kept"],
            )

    added = [T.StructField("bad_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns.

    As ``scored``, but nothing is added: all columns come back as they were, whatever their names.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs.select("doc_id", "text"), labels))
    return filtered(docs, lambda texts: _scores(scorer.value, texts) < threshold)
