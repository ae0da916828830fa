"""Tell the language of texts by multinomial naive Bayes over hashed character n-grams.

Every text gives its n-grams of 1 to ``LONGEST`` code points, A-Z in lower case and white space as one blank; each is
hashed into one of ``bins``. Training adds the n-grams up by language in Spark; the log
probabilities, smoothed by ``ADDED``, form one matrix of languages by bins, whose size does not depend on the corpus,
and which every task gets. Scoring counts each text's bins once (a sparse row) and adds the matrix columns times the
counts.

The matrix has at most ``LARGEST_MATRIX`` entries: with more than 128 languages the bins are halved until it fits, and
more than 16 384 different languages are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivulet.llm import words

LONGEST = 3
BINS = 1 << 16
LEAST_BINS = 1 << 9
LARGEST_MATRIX = 1 << 23
ADDED = 0.5
UNKNOWN = "und"
SLICE_BYTES = 1 << 19
BLANK = 32
_ODD, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
LETTER = r"\p{L}"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    """Languages in code-point order, log prior of each and log probability of each bin by language."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the index of each row's first one (one more entry than rows)."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    first = data[at].astype(np.uint32)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    out = first & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], dtype=np.uint32)[size]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] = (out[more] << np.uint32(6)) | (data[np.minimum(at[more] + k, len(data) - 1)] & np.uint8(0x3F))
    return out, np.searchsorted(at, offsets)


def grams(data: np.ndarray, offsets: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and row of every n-gram of the rows; ``bins`` is a power of two."""
    points, first = code_points(words.lower_ascii(data), offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(first))
    # Only the first of several white spaces stays, as a blank.
    gap = words.SPACE[np.minimum(points, 255)]
    keep = ~gap
    keep[:1] = True
    keep[1:] |= ~gap[:-1]
    points[gap] = BLANK
    points, row = points[keep], row[keep]
    shift = np.uint32(32 - bins.bit_length() + 1)
    hashes, found, owner = points * _ODD, [], []
    for size in range(1, LONGEST + 1):
        own = row
        if size > 1:
            hashes = (hashes[:-1] ^ points[size - 1 :]) * _ODD
            hashes ^= hashes >> np.uint32(15)
            own = row[: len(hashes)]
        number = (hashes * _SPREAD) >> shift
        if size > 1:
            inside = own == row[size - 1 :]
            number, own = number[inside], own[inside]
        found.append(number)
        owner.append(own)
    return np.concatenate(found), np.concatenate(owner)


def sparse(number: np.ndarray, row: np.ndarray, rows: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of rows by bins as row, bin and count of its entries that are not zero."""
    kind = np.uint32 if rows * bins < 1 << 32 else np.uint64
    keys = row.astype(kind) * kind(bins) + number
    keys.sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at] // kind(bins), keys[at] % kind(bins), np.diff(np.append(at, len(keys)))


def _counted(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    """language, bin, n: the n-grams of a task's texts, added up as long as they fit the largest matrix."""

    def flush() -> pa.RecordBatch:
        lang, number = np.nonzero(total[: len(known)])
        names = pa.array(list(known), pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays(
            [names, pa.array(number), pa.array(total[lang, number])], ["lang", "bin", "n"]
        )

    known: dict[str, int] = {}
    total = np.zeros((8, bins), dtype=np.int64)
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for low, high, data, offsets in words.slices(batch.column("text"), SLICE_BYTES):
            if len(known) * bins >= LARGEST_MATRIX:
                yield flush()
                known, total = {}, np.zeros((8, bins), dtype=np.int64)
            own = np.array([known.setdefault(lang, len(known)) for lang in langs[low:high]], dtype=np.int64)
            if len(known) > len(total):
                total = np.concatenate([total, np.zeros((len(known), bins), dtype=np.int64)])
            number, row = grams(data, offsets, bins)
            for lang in np.unique(own).tolist():
                total[lang] += np.bincount(number[(own == lang)[row]], minlength=bins)
    if known:
        yield flush()


def learn(training: DataFrame, bins: int = BINS, added: float = ADDED) -> Model:
    """The model of the texts of ``training`` that have a lang and a letter."""
    rows = training.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    texts = dict(sorted(rows.groupBy("lang").agg(F.count("*")).limit(LARGEST_MATRIX // LEAST_BINS + 1).collect()))
    if len(texts) * LEAST_BINS > LARGEST_MATRIX:
        raise ValueError("too many different languages for one matrix")
    while len(texts) * bins > LARGEST_MATRIX:
        bins //= 2
    counted = rows.mapInArrow(lambda batches: _counted(batches, bins), "lang string, bin long, n long")
    table = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    index = {lang: k for k, lang in enumerate(texts)}
    count = np.zeros((len(index), bins))
    for chunk in table.to_batches():
        own = np.array([index[lang] for lang in chunk["lang"].to_pylist()], dtype=np.int64)
        count[own, chunk["bin"].to_numpy()] = chunk["n"].to_numpy()
    logs = np.log(count + added) - np.log(count.sum(1, keepdims=True) + added * bins)
    seen = np.array(list(texts.values()), dtype=float)
    return Model(list(texts), np.log(seen / seen.sum()) if len(seen) else seen, logs)


def _posterior(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each language for each row."""
    rows, bins = len(offsets) - 1, model.logs.shape[1]
    number, row = grams(data, offsets, bins)
    row, number, counts = sparse(number, row, rows, bins)
    total = np.stack([np.bincount(row, counts * logs[number], rows) for logs in model.logs], 1) + model.prior
    total -= total.max(1, keepdims=True)
    odds = np.exp(total)
    return odds / odds.sum(1, keepdims=True)


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
        best, score = np.zeros(len(lettered), dtype=np.int64), np.zeros(len(lettered))
        if model.languages:
            for low, high, data, offsets in words.slices(batch.column("text"), SLICE_BYTES):
                each = _posterior(model, data, offsets)
                best[low:high], score[low:high] = each.argmax(1), each.max(1)
        names = pa.array([*model.languages, UNKNOWN])
        told = lettered & bool(model.languages)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), batch.column("held_out"),
            names.take(pa.array(np.where(told, best, len(model.languages)))), pa.array(np.where(told, score, 0.0)),
        ], ["doc_id", "held_out", "lang_pred", "score"])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; reads doc_id, held_out and the whole text.

    ``score`` is the posterior probability of the predicted language; of equal ones the first language in code-point
    order is taken. A null text, or one without a letter (``\\p{L}``), is ``und`` with a score of 0, and so is every
    text if nothing was learnt. Repeated rows each give a row; other columns are not looked at. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered")
    return docs.select("doc_id", "text", "held_out", lettered).mapInArrow(
        lambda batches: _predicted(batches, shared.value), PREDICTED
    )
