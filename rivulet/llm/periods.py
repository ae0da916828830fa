"""Find and collapse periodic runs of words by maximal pairs.

A maximal pair is two places of a text whose words agree for ``n`` words, differ before them and differ after them. A
pair at distance p with n >= p is exactly a stretch of p + n words that has period p and that no neighbour extends, so
nothing has to be extended or tried out: the runs are the maximal pairs whose distance satisfies p <= n and
p + n >= ``least``. A stretch is found once for each multiple of its smallest period; the smallest one stays.

Maximal pairs come from the suffixes of the text, sorted by doubling the number of words they are sorted by, and from
the tree of their common-prefix intervals, which is walked from the leaves up. Each node holds its suffixes' places,
all of them and by the word to their left; when a child joins a node, each place of the smaller side looks for places
of the larger side within the distance that the node's depth allows, stepping over those with the same left word by
binary search. So the work follows the number of runs and the places moved from the smaller side, not the number of
pairs. Only suffixes that share ``least`` / 2 words with another one of the text are in the tree.

Several texts are sorted at once; their words count as different, so no interval crosses a border.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS = 12
SLICE_WORDS = 200_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _heads(changed: np.ndarray) -> np.ndarray:
    """For each place of a sorted table, where its group begins; ``changed`` marks the first of each group."""
    at = np.flatnonzero(changed)
    return np.repeat(at, np.diff(np.append(at, len(changed))))


class Suffixes:
    """The suffixes of texts (``stop`` is where the text of each place ends) that share ``least`` words with another.

    ``places`` has them in sorted order and ``common[k]`` is the number of words that the k-th and the next one share.
    """

    def __init__(self, codes: np.ndarray, stop: np.ndarray, least: int):
        n = len(codes)
        self.stop, self.levels = stop, []
        rank = np.empty(n, dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        first = np.ones(n, dtype=bool)
        first[1:] = codes[order[1:]] != codes[order[:-1]]
        heads = _heads(first)
        rank[order] = heads
        live = self._shared(order, heads)
        self.levels.append((live, rank[live]))
        size, wanted = 1, live
        while len(live):
            after = live + size
            beyond = after >= stop[live]
            second = np.where(beyond, 0, rank[np.minimum(after, n - 1)] + 1)
            order = np.argsort(rank[live] * (n + 1) + second, kind="stable")
            sorted_live, old, second = live[order], rank[live[order]], second[order]
            begins = np.ones(len(live), dtype=bool)
            begins[1:] = old[1:] != old[:-1]
            first = begins.copy()
            first[1:] |= second[1:] != second[:-1]
            heads = _heads(first)
            rank[sorted_live] = old + heads - _heads(begins)
            live = self._shared(sorted_live, heads)
            size *= 2
            self.levels.append((live, rank[live]))
            if size <= least:
                wanted = live
        self.places = wanted[np.argsort(rank[wanted], kind="stable")]
        self.common = self._common(self.places[:-1], self.places[1:])

    @staticmethod
    def _shared(places: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Those of the sorted places whose group has another member, in the order of the text."""
        alone = np.ones(len(heads), dtype=bool)
        alone[1:] &= heads[1:] != heads[:-1]
        alone[:-1] &= heads[:-1] != heads[1:]
        return np.sort(places[~alone])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two suffixes share: from the largest power of two down, whether the next so many do."""
        out = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            live, rank = self.levels[level]
            if not len(live):
                continue
            i, j = a + out, b + out
            at, bt = (np.minimum(np.searchsorted(live, x), len(live) - 1) for x in (i, j))
            out += ((live[at] == i) & (live[bt] == j) & (rank[at] == rank[bt])).astype(np.int64) << level
        return out


def _joined(node: list, child: list, left: list[int], emit) -> list:
    """Report the maximal pairs between a node's places and a further child's, and put the child into the node."""
    depth = node[0]
    large, small = (node, child) if len(node[1]) >= len(child[1]) else (child, node)
    _, places, classes = large
    for x in small[1]:
        low, high = bisect_left(places, x - depth), bisect_right(places, x + depth)
        own = classes.get(left[x])
        if own is None:
            for y in places[low:high]:
                emit(x, y, depth)
            continue
        same = bisect_left(own, x - depth)
        while high - low > bisect_right(own, x + depth) - same:
            # The first place that is not one of the class: up to it, both lists agree.
            near, far = 0, high - low - 1
            while near < far:
                middle = (near + far) // 2
                if same + middle < len(own) and places[low + middle] == own[same + middle]:
                    near = middle + 1
                else:
                    far = middle
            emit(x, places[low + near], depth)
            low, same = low + near + 1, same + near
    for x in small[1]:
        insort(places, x)
        insort(classes.setdefault(left[x], []), x)
    return [depth, places, classes]


def _walk(places: list[int], common: list[int], left: list[int], emit) -> None:
    """The interval tree over suffixes in sorted order, from the leaves up."""
    stack, current = [], [0, [places[0]], {left[places[0]]: [places[0]]}]
    for k, depth in enumerate(common):
        while stack and stack[-1][0] > depth:
            current = _joined(stack.pop(), current, left, emit)
        if stack and stack[-1][0] == depth:
            stack.append(_joined(stack.pop(), current, left, emit))
        else:
            stack.append([depth, current[1], current[2]])
        x = places[k + 1]
        current = [0, [x], {left[x]: [x]}]
    while stack:
        current = _joined(stack.pop(), current, left, emit)


def runs(codes: np.ndarray, stop: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, by start and period.

    ``codes`` are the words of texts, back to back, no two texts having a number in common.
    """
    shared = max(1, (least + 1) // 2)
    table = Suffixes(codes, stop, shared)
    places, common = table.places, table.common
    left = np.full(len(codes), -1, dtype=np.int64)
    left[1:] = np.where(stop[1:] == stop[:-1], codes[:-1], -1)
    deep = common >= shared
    edge = np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Groups of two suffixes are one pair each.
    two = ends - begins == 1
    a, b, n = places[begins[two]], places[begins[two] + 1], common[begins[two]]
    period = np.abs(a - b)
    good = (period <= n) & (period + n >= least) & (left[a] != left[b])
    starts, lengths, periods = [np.minimum(a, b)[good]], [(period + n)[good]], [period[good]]

    found: list[tuple[int, int, int]] = []

    def emit(x: int, y: int, depth: int) -> None:
        apart = y - x if y > x else x - y
        if apart + depth >= least:
            found.append((x if x < y else y, apart + depth, apart))

    if not two.all():
        words_left = left.tolist()
        for s, e in zip(begins[~two].tolist(), ends[~two].tolist()):
            _walk(places[s : e + 1].tolist(), common[s:e].tolist(), words_left, emit)
    if found:
        more = np.array(found, dtype=np.int64)
        starts.append(more[:, 0]), lengths.append(more[:, 1]), periods.append(more[:, 2])
    start, length, period = (np.concatenate(x) for x in (starts, lengths, periods))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least_period = np.ones(len(start), dtype=bool)
    least_period[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least_period], length[least_period], period[least_period]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(words: list[bytes], own: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in own:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep) if k]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            ids.append(doc_id)
            # Without an argument, bytes are split at ASCII white space.
            texts.append((text or b"").split())
            size += len(texts[-1]) + 1
            if size >= SLICE_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in _slices(batches):
        sizes = np.array([len(words) for words in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        codes, base = [], 0
        for words in texts:
            number = {}
            codes += [base + number.setdefault(w, len(number)) for w in words]
            base += len(number)
        start, length, period = runs(np.array(codes, dtype=np.int64), np.repeat(ends, sizes), least)
        text_of = np.searchsorted(ends, start, side="right")
        counts = np.bincount(text_of, minlength=len(texts))
        start = start - (ends - sizes)[text_of] if len(start) else start
        own_at = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for k, words in enumerate(texts):
            if counts[k]:
                own = slice(own_at[k], own_at[k + 1])
                words = _collapsed(words, list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist())))
            out.append(b" ".join(words))
        each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(RUN))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(own_at, pa.int32()), each),
            pa.array(out, pa.binary()).cast(pa.string()),
        ], ["doc_id", "n_words", "runs", "collapsed"])


def repetitions(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared exactly and numbered from 0. ``runs`` has start, length
    and smallest period of every run of at least ``least`` words and two periods, by start and period. The collapsed
    text joins by one space the words that no run holds behind its first period. Null and empty texts have no words,
    no runs and an empty collapsed text. Repeated rows each give a row; columns other than doc_id and text are not
    looked at. No rows give no rows. One text's words and one slice of words are held in memory at a time.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _found(batches, least), FOUND)
