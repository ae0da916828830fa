"""Benchmark passages in documents, found by SimHash windows and confirmed by weighted shingles.

Words are runs of letters and digits in Unicode lower case, so case and punctuation do not hide a passage. For each
benchmark item, windows of about four fifths of its size are fingerprinted at every offset (64-bit SimHash over word
hashes); document windows of the same size start every ``stride`` words, with ``stride`` so short that every passage
of an item's size holds a whole window that starts at one of the item's offsets. A fingerprint is cut into four blocks
of 16 bits, and the index holds each block's values within Hamming distance 1: two fingerprints within ``RADIUS`` = 7
differ by at most 1 in some block, so no pair within the radius is missed. Shingles of five words weigh one over the
number of items that have them; candidates are confirmed by a weighted Jaccard similarity of at least 0.8 on the
item-sized windows around what was found, at every offset.

An edit may move a fingerprint farther than the radius. What the fingerprints cannot promise, the weights can: a
window as similar as the threshold t lacks at most 1 - t of an item's weight, so it has at least one of any shingles
that weigh more than that together. Each item's heaviest ones up to that weight are indexed and looked up at every
word of a document, so every window of the threshold's similarity is found, whatever the edits, and what is found does
not depend on how documents are dealt out. A document that lacks too much of an item's weight as a whole is not
confirmed window by window.

The benchmark is a query set that goes against all documents in blocks of a bounded size; only a block is ever sent
to the executors, with twelve bytes for each shingle that several items of the whole benchmark have, so that a weight
does not depend on the blocks. Documents are not shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rivulet.llm import words
from rivulet.llm.components import filtered

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 7
BLOCK_BYTES = 1 << 20
LARGEST_WINDOW = 32_000
# Sums of that many bits fit eight to a 64-bit number, larger ones four.
MOST_IN_OCTETS = 254
HITS = "doc_id long, item_id long, start long, n_words long, similarity double"
_SPREAD = np.array(
    [sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64
)
_ONES = np.uint64(0x0101010101010101)
_SPREAD4 = np.array([sum(((b >> k) & 1) << (16 * k) for k in range(4)) for b in range(16)], dtype=np.uint64)
_ONES4 = np.uint64(0x0001000100010001)


def simhashes(hashes: np.ndarray, size: int, stride: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words (at most 32 766) that start every ``stride`` words.

    Bit counts are kept eight (or four) to a 64-bit number; differences of running sums are exact even where the sums
    wrap.
    """
    out = np.zeros(max(0, (len(hashes) - size) // stride + 1), dtype=np.uint64)
    if size > MOST_IN_OCTETS:
        most = np.uint64((1 << 15) - (size // 2 + 1)) * _ONES4
        for k in range(16):
            sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(_SPREAD4[(hashes >> np.uint64(4 * k)) & np.uint64(15)], out=sums[1:])
            count = sums[size::stride][: len(out)] - sums[: len(sums) - size : stride][: len(out)]
            high = (count + most) >> np.uint64(15)
            for bit in range(4):
                out |= ((high >> np.uint64(16 * bit)) & np.uint64(1)) << np.uint64(4 * k + bit)
        return out
    octets = hashes.view(np.uint8).reshape(-1, 8)
    most = np.uint64(128 - (size // 2 + 1)) * _ONES
    for k in range(8):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(_SPREAD[octets[:, k]], out=sums[1:])
        count = sums[size::stride][: len(out)] - sums[: len(sums) - size : stride][: len(out)]
        high = ((count + most) & (_ONES << np.uint64(7))) >> np.uint64(7)
        out |= ((high * np.uint64(0x0102040810204080)) >> np.uint64(56)) << np.uint64(8 * k)
    return out


def window_size(n: int) -> int:
    """Four fifths of an item's size, down to the next of a series of sizes that grow by about a fifth."""
    want, size = min(LARGEST_WINDOW, -(-4 * n // 5)), 1
    while max(size + 1, size * 6 // 5) <= want:
        size = max(size + 1, size * 6 // 5)
    return size


class Block:
    """The index of a block of benchmark items."""

    def __init__(
        self, items: list[tuple[int, str]], shingle: int, threshold: float, common: tuple[np.ndarray, np.ndarray]
    ):
        self.shingle, self.threshold = shingle, threshold
        self.ids, self.sizes, self.sets = [], [], []
        by_size, by_shingle, all_words = defaultdict(list), defaultdict(list), []
        for item_id, text in items:
            own = _words(pa.array([text or ""]))[0][0]
            if not len(own):
                continue
            self.ids.append(item_id)
            self.sizes.append(len(own))
            self.sets.append(Counter(words.shingles(own, shingle).tolist()))
            all_words.append(own)
            by_size[window_size(len(own))].append(len(self.ids) - 1)
            by_shingle[min(shingle, len(own))].append(len(self.ids) - 1)
        self.common, self.seen = common
        # The distinct shingles of each item, heaviest first, and what they weigh with their repetitions.
        self.keys, self.held, self.full = [], [], []
        for own in self.sets:
            keys = np.array(sorted(own), dtype=np.uint64)
            held = self.weights(keys) * np.array([own[k] for k in keys.tolist()])
            order = np.argsort(-held, kind="stable")
            self.keys.append(keys[order])
            self.held.append(held[order])
            self.full.append(float(held.sum()))
        self.windows = []
        for size, members in sorted(by_size.items()):
            stride = min(self.sizes[m] for m in members) - size + 1
            prints = [simhashes(all_words[m], size, 1) for m in members]
            owner = np.repeat(members, [len(p) for p in prints])
            self.windows.append((size, stride, np.concatenate(prints), owner, _index(np.concatenate(prints))))

        self.heavy = []
        for size, members in sorted(by_shingle.items()):
            # One more than needed where the sum meets the bound, so that rounding cannot leave one out.
            number = [
                int(np.searchsorted(np.cumsum(self.held[m]), (1 - threshold) * self.full[m] + 1e-9, side="right")) + 1
                for m in members
            ]
            keys = [self.keys[m][:n] for m, n in zip(members, number)]
            owner = np.repeat(members, [len(k) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            self.heavy.append((size, keys[order], owner[order]))

    def candidates(self, hashes: np.ndarray, row: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(row, item, where a window starts, its size) of windows within the radius of an item's and of its heavy
        shingles."""
        found = set()

        def add(size, at, items):
            found.update(zip(row[at].tolist(), items.tolist(), at.tolist(), [size] * len(at)))

        def spread(hit, low, high):
            count = high - low
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            return np.repeat(hit, count), np.repeat(low, count) + step

        for size, stride, prints, owner, index in self.windows:
            own = simhashes(hashes, size, stride)
            at = np.arange(len(own)) * stride
            for k, (heads, values) in enumerate(index):
                block = ((own >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
                low, high = heads[block], heads[block + 1]
                hit = np.flatnonzero((high > low) & (row[at] == row[np.minimum(at + size - 1, len(row) - 1)]))
                if not len(hit):
                    continue
                which, target = spread(hit, low[hit], high[hit])
                target = values[target]
                near = np.bitwise_count(own[which] ^ prints[target]) <= RADIUS
                add(size, at[which[near]], owner[target[near]])
        for size, keys, owner in self.heavy:
            if len(hashes) < size:
                continue
            own = words.combine([hashes[k : len(hashes) - size + 1 + k] for k in range(size)])
            low = np.searchsorted(keys, own)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == own)
            hit = hit[row[hit] == row[hit + size - 1]]
            which, target = spread(hit, low[hit], np.searchsorted(keys, own[hit], side="right"))
            add(size, which, owner[target])
        return found

    def possible(self, item: int, text: np.ndarray) -> bool:
        """Whether the whole text has enough of the item's weight for a window to reach the threshold."""
        have = np.isin(self.keys[item], words.shingles(text, min(self.shingle, self.sizes[item])))
        return float(self.held[item][have].sum()) >= self.threshold * self.full[item] - 1e-9

    def best(self, item: int, text: np.ndarray, found: list[tuple[int, int]]) -> tuple[float, int, int]:
        """Similarity, start and words of the best window that holds a found one (start and size within the text).

        Windows have the item's size, less what lies beyond the ends of the text; of equal ones the first is told.
        """
        n, own, theirs, best = self.sizes[item], min(self.shingle, self.sizes[item]), self.sets[item], (0.0, 0, 0)
        spans = []
        for low, high in sorted((at + size - n, at) for at, size in found):
            if spans and low <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        for low, high in spans:
            base, end = max(low, 0), min(high + n, len(text))
            if end - base < own:
                continue
            values = words.shingles(text[base:end], own)
            weight, values = self.weights(values).tolist(), values.tolist()
            have, shared, total = Counter(), 0.0, self.full[item]
            first = last = 0
            for start in range(low, high + 1):
                to = max(0, min(start + n, len(text)) - own + 1 - base)
                for k in range(last, to):
                    value = values[k]
                    if have[value] < theirs.get(value, 0):
                        shared += weight[k]
                    else:
                        total += weight[k]
                    have[value] += 1
                last = max(last, to)
                for k in range(first, max(start, 0) - base):
                    value = values[k]
                    have[value] -= 1
                    if have[value] < theirs.get(value, 0):
                        shared -= weight[k]
                    else:
                        total -= weight[k]
                first = max(first, max(start, 0) - base)
                if shared > (best[0] + 1e-9) * total:
                    begin = max(start, 0)
                    best = (shared / total, begin, min(start + n, len(text)) - begin)
        if best[2]:
            begin, size = best[1:]
            best = (self.similarity(item, text[begin : begin + size]), begin, size)
        return best

    def weights(self, values: np.ndarray) -> np.ndarray:
        """One over the number of items of the whole benchmark that have each shingle; 1 for shingles of no item."""
        out = np.ones(len(values))
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, values), len(self.common) - 1)
            own = self.common[at] == values
            out[own] = 1.0 / self.seen[at[own]]
        return out

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the multisets of shingles."""
        own = Counter(words.shingles(window, self.shingle).tolist())
        theirs, shared, total = self.sets[item], 0.0, 0.0
        values = sorted(own.keys() | theirs.keys())
        for value, weight in zip(values, self.weights(np.array(values, dtype=np.uint64)).tolist()):
            shared += weight * min(own[value], theirs[value])
            total += weight * max(own[value], theirs[value])
        return shared / total if total else 0.0


def _index(prints: np.ndarray):
    """For each of four blocks of 16 bits: where the list of each value starts, and the prints within distance 1."""
    flips = np.array([0] + [1 << b for b in range(16)], dtype=np.int64)
    out = []
    for k in range(4):
        block = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
        values = (block[:, None] ^ flips).reshape(-1)
        order = np.argsort(values, kind="stable")
        heads = np.zeros((1 << 16) + 1, dtype=np.int64)
        np.cumsum(np.bincount(values, minlength=1 << 16), out=heads[1:])
        out.append((heads, order // len(flips)))
    return out


def _words(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    out = []
    for low, high, data, offsets in words.slices(lowered):
        hashes, first = words.word_hashes(data, offsets, words.PUNCTUATION)
        out.append((hashes, first, low, high))
    return out or [(np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), 0, 0)]


def _hits(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("doc_id"), []
        for hashes, first, low, high in _words(batch.column("text")):
            if not len(hashes):
                continue
            row = np.repeat(np.arange(high - low), np.diff(first))
            found = defaultdict(list)
            for doc, item, at, size in block.candidates(hashes, row):
                found[doc, item].append((at - int(first[doc]), size))
            for (doc, item), places in found.items():
                text = hashes[first[doc] : first[doc + 1]]
                if not block.possible(item, text):
                    continue
                alike, start, n = block.best(item, text, places)
                if alike >= block.threshold - 1e-9:
                    rows.append((ids[low + doc].as_py(), block.ids[item], start, n, alike))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(
                list(zip(*rows)) or [()] * 5, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            )],
            ["doc_id", "item_id", "start", "n_words", "similarity"],
        )


def _item_shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The shingles of every item, each once an item."""
    for batch in batches:
        for hashes, first, low, high in _words(batch.column("text")):
            own = [np.unique(words.shingles(hashes[first[k] : first[k + 1]], shingle)) for k in range(high - low)]
            keys = np.concatenate([np.zeros(0, dtype=np.uint64), *own])
            yield pa.RecordBatch.from_arrays([pa.array(words.signed(keys))], ["key"])


def common_shingles(benchmark: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several items of the whole benchmark have, sorted, and how many have each."""
    rows = benchmark.select("item_id", "text").distinct()
    keys = rows.mapInArrow(lambda batches: _item_shingles(batches, shingle), "key long")
    found = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    values, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.int32)
    order = np.argsort(values)
    return values[order], n[order]


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about ``size`` bytes of text."""
    rows = benchmark.select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = total // size + 1
    for k in range(number):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        yield [tuple(r) for r in own.sort("item_id", "text").collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the benchmark items that documents contain.

    ``start`` and ``n_words`` tell the best window in words of the document; of equal ones the first. A document row
    gives a row per item it contains, so repeated rows repeat theirs. An item with fewer words than ``shingle`` is one
    shingle. Null and empty texts contain nothing, items without words are contained in nothing, and a null doc_id is
    carried as it is. Columns other than doc_id, item_id and text are not looked at. No rows on either side give none.
    """
    spark, out, common = docs.sparkSession, None, common_shingles(benchmark, shingle)
    for items in blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(Block(items, shingle, threshold, common))
        found = docs.select("doc_id", "text").mapInArrow(lambda batches, b=block: _hits(batches, b.value), HITS)
        out = found if out is None else out.unionByName(found)
    return out


def cleaned(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their columns; nothing is shuffled.

    Only the column text is looked at; all columns come back as they were, whatever their names. Null and empty texts
    contain nothing and stay, rows that repeat stay or go together, null doc_ids are kept as they are. Items without
    words are contained in nothing; no items leave all rows, no rows give none.
    """
    spark, common = docs.sparkSession, common_shingles(benchmark, shingle)

    def clean(texts: pa.Array, block: Block) -> np.ndarray:
        good = np.ones(len(texts), dtype=bool)
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["doc_id", "text"])
        for hits in _hits(iter([place]), block):
            good[hits.column("doc_id").to_numpy()] = False
        return good

    for items in blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(Block(items, shingle, threshold, common))
        docs = filtered(docs, lambda texts, b=block: clean(texts, b.value))
    return docs
