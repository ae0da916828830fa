"""Group spelling variants: words of a corpus that are one edit apart, by a variable-length gram index.

The gram dictionary. Words stand between two border signs. A gram of two symbols is in the dictionary; a longer one is
if the gram without its last symbol is frequent (more than ``FREQUENT`` occurrences in all words), so that common grams
are replaced by their extensions and rare ones are leaves. Only the frequent grams need to be known, as 64-bit hashes;
``LARGEST_DICTIONARY`` bounds their number by raising the least frequency with the number of grams counted.

Decomposition. At each place of a word stands the longest gram of the dictionary, of at most a class's longest size;
grams inside an earlier one are left out. Class m compares words of length m with each other and with those of length
m + 1 and takes grams of at most (m + 2) / 2 symbols, so that one edit never reaches both the first and the last gram.

Bounds. For each place of an edit, the grams before it are safe, and so are those behind it that no gram of the edited
word can swallow: a gram that starts at or before the edit swallows one that ends ``a`` symbols behind it only if it
is long enough and the ``a - 1`` symbols between are frequent. The least number of safe grams over all places is what
the word shares, at the same distance from its beginning or its end, with every word one edit away.

Merging. If words share at least ``b`` of their grams, they share one of each one's rarest ones, all but ``b - 1`` (ties
included). Only those lists are merged: each posting meets the postings of the same gram at the same place, and a pair
that meets is verified by its edit distance at once, so pairs that are not near leave no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivulet.llm import words
from rivulet.llm.components import written

LEAST_LENGTH = 5
LEAST_COUNT = 3
DROP_EVERY = 97
FREQUENT = 64
SHORTEST_GRAM = 2
LONGEST_GRAM = 12
LARGEST_DICTIONARY = 4_000_000
# A common word of a slice is counted once; larger slices give fewer rows.
SLICE_BYTES = 1 << 22
LONG_RUN = 256
HELD_WORDS = 50_000
BEGIN, END = 1, 2
# Postings of one key that a joining task meets at a time; larger lists are dealt out in blocks.
BLOCK = 2048
POSTED = "key long, word string, n long, odd long, longer boolean, behind boolean"

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (_CRC & np.uint32(1)))


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of a-z and U+00C0 to U+00FF, whose bytes are C3 and one more."""
    lead = data == 0xC3
    inside = ((data >= 97) & (data <= 122)) | lead
    inside[1:] |= lead[:-1]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border[1:-1]
    end[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans, each continued from the checksum ``before`` it."""
    state = before ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    live = np.flatnonzero(size <= LONG_RUN)
    at, left = starts[live], size[live]
    while live.size:
        state[live] = _CRC[(state[live] ^ data[at]) & np.uint32(255)] ^ (state[live] >> np.uint32(8))
        more = left > 1
        live, at, left = live[more], at[more] + 1, left[more] - 1
    state ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > LONG_RUN).tolist():
        state[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return state


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of bytes as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    own = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(own)).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch], least: int, drop_every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for low, high, data, offsets in words.slices(batch.column("text"), SLICE_BYTES):
            if not len(data):
                continue
            data = words.lower_ascii(data)
            starts, ends, row = _letters(data, offsets)
            two = np.concatenate([[0], np.cumsum(data == 0xC3)])
            size = ends - starts - (two[ends] - two[starts])
            long_enough = size >= least
            starts, ends, row, size = (x[long_enough] for x in (starts, ends, row, size))
            changed: dict[str, int] = {}
            if drop_every:
                marks = [zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids[low:high]]
                crc = _crc32(data, starts, ends, np.array(marks, dtype=np.uint32)[row])
                hit = crc % np.uint32(drop_every) == 0
                for s, e, n, h in zip(starts[hit].tolist(), ends[hit].tolist(), size[hit].tolist(), crc[hit].tolist()):
                    word = data[s:e].tobytes().decode()
                    word = word[: h % n] + word[h % n + 1 :]
                    if len(word) >= least:
                        changed[word] = changed.get(word, 0) + 1
                starts, ends = starts[~hit], ends[~hit]
            _, first, count = np.unique(words.hashes(data, starts, ends), return_index=True, return_counts=True)
            found = _gathered(data, starts[first], ends[first])
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([found, pa.array(list(changed), pa.string())]),
                pa.concat_arrays([pa.array(count.astype(np.int64)), pa.array(list(changed.values()), pa.int64())]),
            ], ["word", "n"])


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY
) -> DataFrame:
    """word, n: the words of all whole texts with at least so many code points and occurrences.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z, and only they, in lower case. With ``drop_every``, a word
    whose CRC-32 of ``<doc_id>:<word>`` it divides loses the code point at the checksum's remainder by its length (a
    planted misspelling); 0 leaves all words as they are. A null doc_id is the empty text there; null and empty texts
    have no words. Repeated rows count as often as they occur. No rows give no rows.
    """
    found = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _counted(batches, least_length, drop_every), "word string, n long"
    )
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equally long words and their symbols between the border signs."""
    texts = column.to_pylist()
    size = np.array([len(t) for t in texts])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        per = max(1, HELD_WORDS * 8 // (n + 2))
        for k in range(0, len(rows), per):
            part = rows[k : k + per]
            codes = "".join(texts[r] for r in part.tolist()).encode("utf-32-le", "surrogatepass")
            symbols = np.empty((len(part), n + 2), dtype=np.uint64)
            symbols[:, 0], symbols[:, -1] = BEGIN, END
            symbols[:, 1:-1] = np.frombuffer(codes, dtype="<u4").reshape(len(part), n)
            yield part, symbols


def longest_gram(size: int) -> int:
    """The longest gram of class ``size``: an edit never reaches both the first and the last one."""
    return max(SHORTEST_GRAM, min(LONGEST_GRAM, (size + 2) // 2))


def _hashed(symbols: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """For each size, the hash of the gram at each place."""
    out, last = {}, words.mix(symbols + np.uint64(1))
    for size in range(2, min(longest, symbols.shape[1]) + 1):
        last = words.combine([last[:, :-1], symbols[:, size - 1 :]])
        out[size] = last
    return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [
            hashes.ravel()
            for _, symbols in _by_length(batch.column("word"))
            for hashes in _hashed(symbols, longest_gram(symbols.shape[1] - 2)).values()
        ]
        values, count = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64),) * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.signed(values)), pa.array(count.astype(np.int64))], ["gram", "n"]
        )


def frequent_grams(counted: DataFrame, frequent: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the grams with more than ``frequent`` occurrences in all words.

    At most ``LARGEST_DICTIONARY``: with more grams than that times ``frequent``, the least frequency grows.
    """
    grams = counted.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")
    )
    grams = written(grams.where(F.col("n") > frequent), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(frequent, total // LARGEST_DICTIONARY)
    return np.sort(grams.where(F.col("n") > least).select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def _among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(values.shape, dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Decomposed:
    """The variable-length grams of equally long words under the longest size of a class.

    ``size`` has the size of the gram at each place, ``kept`` whether it is in the decomposition, ``safe`` how many grams
    of it each word shares with any word one edit away, ``order`` a number for each gram that only depends on the gram,
    small for rare ones.
    """

    def __init__(self, symbols: np.ndarray, longest: int, frequent: np.ndarray):
        rows, width = symbols.shape
        places = width - SHORTEST_GRAM + 1
        hashes = _hashed(symbols, longest)
        often = {q: _among(frequent, h) for q, h in hashes.items()}
        self.size = np.full((rows, places), SHORTEST_GRAM)
        self.hash = hashes[SHORTEST_GRAM].copy()
        self.common = often[SHORTEST_GRAM].copy()
        for q in range(SHORTEST_GRAM + 1, longest + 1):
            if q > width:
                break
            grows = self.common[:, : width - q + 1] & (self.size[:, : width - q + 1] == q - 1)
            part = np.s_[:, : width - q + 1]
            self.size[part] = np.where(grows, q, self.size[part])
            self.hash[part] = np.where(grows, hashes[q], self.hash[part])
            self.common[part] = np.where(grows, often[q], self.common[part])
        end = np.arange(places) + self.size
        self.kept = np.ones((rows, places), dtype=bool)
        self.kept[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
        self.order = (self.common.astype(np.uint64) << np.uint64(63)) | (
            (np.uint64(LONGEST_GRAM) - self.size.astype(np.uint64)) << np.uint64(58)
        ) | (self.hash >> np.uint64(6))
        self.safe = self._safe(end, longest, often, width)

    def _safe(self, end: np.ndarray, longest: int, often: dict[int, np.ndarray], width: int) -> np.ndarray:
        rows, places = self.kept.shape
        # Where the kept gram that ends at each place begins; -1 where none ends.
        begins = np.full((rows, width + 1), -1)
        row, place = np.nonzero(self.kept)
        begins[row, end[row, place]] = place
        before = np.cumsum(begins >= 0, axis=1)
        after = np.zeros((rows, width + 1), dtype=np.int64)
        after[:, :places] = np.cumsum(self.kept[:, ::-1], axis=1)[:, ::-1]
        for a in range(SHORTEST_GRAM, longest):
            # Grams that end ``a`` symbols behind an edit just before place j, between which the symbols are frequent.
            within = begins[:, a:] >= np.arange(width + 1 - a)
            if a > SHORTEST_GRAM:
                span = often[a - 1]
                within[:, : span.shape[1]] &= span[:, : within.shape[1]]
            after[:, : width + 1 - a] -= within
        # An edit of the symbol i, for all but the border signs; one between two symbols never leaves fewer.
        return (before[:, 1 : width - 1] + after[:, 2:width]).min(axis=1)


def _posted(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The postings of every word: a key from class, gram and place, from the beginning and from the end."""
    for batch in batches:
        names, counts = batch.column("word"), batch.column("n")
        for rows, symbols in _by_length(names):
            width = symbols.shape[1]
            odd = np.bitwise_xor.reduce(np.uint64(1) << (symbols[:, 1:-1] & np.uint64(63)), axis=1)
            # With the words of its own length or one more, and with those of one less.
            for own in (width - 2, width - 3):
                if own < 1:
                    continue
                parts = Decomposed(symbols, longest_gram(own), frequent)
                total = parts.kept.sum(axis=1)
                ranked = np.sort(np.where(parts.kept, parts.order, np.uint64((1 << 64) - 1)), axis=1)
                last = ranked[np.arange(len(rows)), np.minimum(total - parts.safe, total - 1)]
                row, place = np.nonzero(parts.kept & (parts.order <= last[:, None]))
                gram, size = parts.hash[row, place], parts.size[row, place]
                longer = own == width - 3
                for behind in (False, True):
                    at = width - place - size if behind else place
                    key = words.combine([gram, at.astype(np.uint64), np.full(len(gram), own * 2 + behind, np.uint64)])
                    take = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(words.signed(key)), names.take(take), counts.take(take),
                        pa.array(words.signed(odd[row])),
                        pa.array(np.full(len(key), longer)), pa.array(np.full(len(key), behind)),
                    ], ["key", "word", "n", "odd", "longer", "behind"])


def near_pairs(counted: DataFrame, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """u, u_n, v, v_n: each two words of ``counted`` that are one edit apart, once.

    ``odd`` tells which symbols (modulo 64) a word has an odd number of: one edit changes two of its bits at most, which
    costs next to nothing to see before the edit distance is taken. Lists of more than ``block`` postings are cut into
    blocks by the word's hash, each of which meets the whole other list in a task of its own.
    """
    shared = counted.sparkSession.sparkContext.broadcast(frequent_grams(counted, frequent))
    posted = counted.select("word", "n").mapInArrow(lambda batches: _posted(batches, shared.value), POSTED)
    posted = written(posted, "postings")
    long_lists = posted.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > block).select(
        "key", F.ceil(F.col("held") / block).cast("int").alias("blocks")
    )
    listed = posted.join(long_lists, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = listed.where("NOT longer").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("word").alias("u"),
        F.col("n").alias("u_n"), F.col("odd").alias("u_odd"),
    )
    # Equally long words keep what stands before the edit and behind it at the same distance from the beginning.
    other = listed.where("longer OR NOT behind").select(
        "key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.col("word").alias("v"),
        F.col("n").alias("v_n"), F.col("odd").alias("v_odd"), "longer",
    )
    met = one.join(other.hint("shuffle_merge"), ["key", "block"]).where(
        (F.bit_count(F.col("u_odd").bitwiseXOR(F.col("v_odd"))) <= 2)
        & (F.col("longer") | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1)
    )
    return met.groupBy("u", "v").agg(F.first("u_n").alias("u_n"), F.first("v_n").alias("v_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from each word of (word, form) ends; forms must lead to no word again.

    Every round doubles the steps that a row has taken, so their number is the logarithm of the longest way.
    """
    at = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left")
        at = written(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")),
                     "forms")
        if not at.where("more").limit(1).count():
            return at.select("word", "root")


def variants(counted: DataFrame, ratio: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``counted`` (word, n; each word once).

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, the smallest in code-point order of several, if that is at least ``ratio`` (2 or more) times its own n;
    else null. ``root`` follows forms to the last, the word itself if it has none. Null words and words of under three
    code points are left out of the index: they have no near words. No rows give no rows.
    """
    counted = written(counted.select("word", "n"), "words")
    indexed = counted.where(F.char_length("word") >= 3)
    pairs = written(near_pairs(indexed, frequent), "near")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("v_n").alias("other_n")).unionByName(
        pairs.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("u_n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    large = -F.col("best.less") >= F.col("n") * ratio
    told = written(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.other")).alias("form"),
        F.when(large, -F.col("best.less")).alias("form_n"),
    ), "told")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
