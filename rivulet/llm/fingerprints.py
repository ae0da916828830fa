"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo the prime 2^31 - 1 and for two bases, the sums of its code points times powers
of the base. Any span's hash comes from two entries, so the equality of any two spans costs a constant time, and the
longest common extension of two positions is found by binary search. A fingerprint is the length, the hash of the whole
text and the ``SKETCH`` smallest (scrambled) hashes of all spans of ``SPAN`` code points; the likeness of two
fingerprints estimates the share of such spans that the texts have in common.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivulet.llm import words

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
SPAN = 16
SKETCH = 32
RANGES_PER_PARTITION = 4
_P, _SHIFT = np.uint64(PRIME), np.uint64(31)
EMPTY = "0-0000000000000000-"
PRINTED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder: 2^31 is 1 modulo the prime."""
    return (x & _P) + (x >> _SHIFT)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base, grown as longer texts come."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            factor = np.uint64(pow(self.base, len(self.table), PRIME))
            self.table = np.concatenate([self.table, _reduced(self.table * factor)])
        return self.table[:n]


_POWERS = [_Powers(base) for base in BASES]
_INVERSE = [_Powers(pow(base, -1, PRIME)) for base in BASES]


class Prefix:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for powers in _POWERS:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_folded(codes * powers.upto(self.n)), out=sums[1:])
            # Below 2^31 + 4; only hashes that are compared need to be reduced in full.
            self.sums.append(_folded(_folded(sums)))

    def spans(self, size: int) -> np.ndarray:
        """62-bit hashes of the spans of ``size`` code points at every position."""
        out = None
        for sums, inverse in zip(self.sums, _INVERSE):
            part = _folded(sums[size:] + _P + _P - sums[: self.n + 1 - size])
            part = _reduced(part * inverse.upto(self.n + 1)[: len(part)])
            out = part if out is None else (out << _SHIFT) | part
        return out

    def span(self, start: int, size: int) -> int:
        out = 0
        for sums, inverse in zip(self.sums, _INVERSE):
            back = inverse.upto(self.n + 1)
            out = out << 31 | (int(sums[start + size]) - int(sums[start])) % PRIME * int(back[start]) % PRIME
        return out

    def equal(self, start: int, other: Prefix, other_start: int, size: int) -> bool:
        """Whether two spans of the same size are equal."""
        return self.span(start, size) == other.span(other_start, size)

    def common(self, start: int, other: Prefix, other_start: int) -> int:
        """The longest common extension: how many code points agree from the two positions on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def fingerprint(prefix: Prefix, size: int = SPAN, sketch: int = SKETCH) -> str:
    """Length, whole hash and sketch as hexadecimal text; equal texts have equal fingerprints."""
    if not prefix.n:
        return EMPTY
    values = (words.mix(prefix.spans(min(size, prefix.n))) >> np.uint64(32)).astype(np.uint32)
    least = values
    if len(values) > 8 * sketch:
        least = np.partition(values, 4 * sketch)[: 4 * sketch]
    least = np.unique(least)[:sketch]
    if len(least) < sketch < len(values):
        least = np.unique(values)[:sketch]
    return f"{prefix.n:x}-{prefix.span(0, prefix.n):016x}-" + least.astype(">u4").tobytes().hex()


def likeness(a: str, b: str, sketch: int = SKETCH) -> float:
    """From 0 to 1: 1 for equal fingerprints, else the estimated share of common spans."""
    if a == b:
        return 1.0
    left, right = (s.rpartition("-")[2] for s in (a, b))
    left, right = ({s[k : k + 8] for k in range(0, len(s), 8)} for s in (left, right))
    least = sorted(left | right)[:sketch]
    return sum(x in left and x in right for x in least) / len(least) if least else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _printed(batches: Iterator[pa.RecordBatch], span: int, sketch: int) -> Iterator[pa.RecordBatch]:
    waiting = None
    for batch in batches:
        place, ahead, ids = (batch.column(c).to_pylist() for c in ("place", "ahead", "doc_id"))
        texts, rows = batch.column("text"), []
        for k, own_place in enumerate(place):
            if waiting is None and ahead[k]:
                continue
            text = texts[k].as_py() or ""
            prefix = Prefix(text)
            here = (own_place, ids[k], text, prefix, fingerprint(prefix, span, sketch))
            if waiting is not None:
                _, doc_id, old, old_prefix, mark = waiting
                changed = edited(old, text)
                changed_prefix = Prefix(changed)
                changed_mark = fingerprint(changed_prefix, span, sketch)
                rows.append((
                    doc_id, len(old), hashlib.sha256(changed.encode()).hexdigest(), mark, changed_mark,
                    likeness(mark, changed_mark, sketch), likeness(mark, here[4], sketch),
                    old_prefix.common(0, changed_prefix, 0),
                ))
            waiting = None if ahead[k] else here
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
        names = [c.split()[0] for c in PRINTED.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


def fingerprinted(docs: DataFrame, span: int = SPAN, sketch: int = SKETCH) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends in the beginning of the next document's.

    The next document is the one of next smaller doc_id (ties by text, null ids last); after the last comes the first.
    Null texts are empty; empty texts have one common fingerprint. A single row is its own next. Repeated rows are
    each other's next and each give a row. Columns other than doc_id and text are not looked at. No rows give no rows.

    Documents are dealt out once, by ranges of doc_id whose number follows the cluster, and each task streams through
    its ranges in order. The first document of a range is also sent to the range before it, so no task needs another.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    last = len(cuts) + 1

    @F.pandas_udf("int")
    def range_of(column: pd.Series) -> pd.Series:
        place = len(cuts) - np.searchsorted(cuts, column.fillna(0).to_numpy(), side="left")
        return pd.Series(np.where(column.isna(), last, place))

    # One row per range, so at most ``ranges`` + 1.
    heads = sorted(tuple(r) for r in ids.withColumn("place", range_of("doc_id")).groupBy("place").agg(
        F.max("doc_id")
    ).collect())
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads) if head is not None}
    null_before = next((heads[k - 1][0] for k, (_, head) in enumerate(heads) if head is None), -1)
    head_ids = np.array(sorted(before), dtype=np.int64)
    head_places = [before[h] for h in head_ids.tolist()]

    @F.pandas_udf("int")
    def range_before(column: pd.Series) -> pd.Series:
        own = [
            null_before if pd.isna(x) else head_places[k]
            if (k := bisect_left(head_ids, x)) < len(head_ids) and head_ids[k] == x else -1
            for x in column
        ]
        return pd.Series(own, dtype="int32")

    stands = F.array(
        F.struct(range_of("doc_id").alias("place"), F.lit(False).alias("ahead")),
        F.struct(range_before("doc_id").alias("place"), F.lit(True).alias("ahead")),
    )
    dealt = docs.select("doc_id", "text", F.explode(stands).alias("stand")).where("stand.place >= 0").select(
        "stand.place", "stand.ahead", "doc_id", "text"
    )
    ordered = dealt.repartition("place").sortWithinPartitions(
        "place", "ahead", F.col("doc_id").desc_nulls_last(), "text"
    )
    return ordered.mapInArrow(lambda batches: _printed(batches, span, sketch), PRINTED)
