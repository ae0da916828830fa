"""Repeated passages, found by hashing lines and the sentences within them.

A text's units are its lines, cut further at the ends of sentences and after words that their hash picks (one in
``ANCHORS``), where at least ``LEAST_PIECE`` words stand between two such places. The places depend on the words around
them alone, so a passage inside a line has units of its own, the same wherever it stands. Units are normalised (words in A-Z lower case, white space between them dropped), and their
128-bit digests are grouped over all documents; the document of the smallest doc_id, and in it the first place, keeps
a unit. A run of neighbouring units that all have an earlier place goes if it holds at least ``LEAST_RUN`` words, and
``LEAST_SHARED`` of them are kept by one document or stand in units of which each two neighbours stand together in an
earlier document, too: phrases that recur by chance, here and there, stay. Whole lines whose units stand together
earlier go from ``LEAST_LINE`` words on; shorter stock lines stay outside of a longer run. A unit of few words is hashed together with the unit before
it (the first of a text with the one behind it): it counts as repeated only in the same company.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rivulet.llm import words
from rivulet.llm.components import written

LEAST_PIECE = 4
ANCHORS = 6
LEAST_UNIT = 3
LEAST_RUN = 20
LEAST_SHARED = 12
LEAST_LINE = 5
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True
REMOVED = (
    "doc_id long, n_words long, n_removed long, text string, "
    "removed array<struct<start: long, end: long, n_words: long, kept_in: array<long>>>, kept_in array<long>"
)


def units(data: np.ndarray, offsets: np.ndarray):
    """Of each unit: row, first and last byte, number of words, two digests, and whether it ends a line."""
    starts, ends, first = words.spans(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(n, dtype=bool)
    last[:-1] = newlines[starts[1:]] > newlines[ends[:-1]]
    last[:-1] |= row[1:] != row[:-1]
    last[-1] = True
    hashes = words.hashes(words.lower_ascii(data), starts, ends)
    stop = _ENDS[data[ends - 1]]
    # Where every word ends like a sentence, such ends say nothing.
    stop[1:] &= ~_ENDS[data[ends[:-1] - 1]]
    at = np.flatnonzero(last | stop | (words.mix(hashes) % np.uint64(ANCHORS) == 0))
    length = np.diff(np.concatenate([[-1], at]))
    tail = at[last[at] | (length >= LEAST_PIECE)]
    head = np.concatenate([[0], tail[:-1] + 1])
    count = tail - head + 1
    place = (np.arange(n) - np.repeat(head, count)).astype(np.uint64)
    turned = words.mix(hashes + words.mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)))
    a = words.mix(np.add.reduceat(turned, head))
    b = words.mix(np.add.reduceat(words.mix(turned ^ np.uint64(0x5851F42D4C957F2D)), head))
    owner, at = row[head], np.arange(len(head))
    before, behind = np.maximum(at - 1, 0), np.minimum(at + 1, len(at) - 1)
    near = np.where((owner[before] == owner) & (before < at), before, behind)
    short = np.flatnonzero((count < LEAST_UNIT) & (owner[near] == owner) & (near != at))
    together = [words.combine([d[near[short]], d[short]]) for d in (a, b)]
    a[short], b[short] = together
    return owner, starts[head], ends[tail], count, a, b, last[tail]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in words.slices(batch.column("text")):
            row, _, _, _, a, b, _ = units(data, offsets)
            index = np.arange(len(row)) - np.searchsorted(row, row)
            take = pa.array(low + row)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()).take(take), batch.column("text_hash").take(take),
                pa.array(index.astype(np.int32)), pa.array(words.signed(a)), pa.array(words.signed(b)),
            ], ["doc_id", "text_hash", "unit", "a", "b"])


def _shared(keeper: list[int], joined: list[bool], count: list[int]) -> int:
    """Most words of a run that one document keeps, or that stand in units joined to their neighbours earlier.

    ``joined`` tells of each unit but the last whether it stands earlier together with the next.
    """
    one: dict[int, int] = {}
    most = chain = 0
    for k, (holder, n) in enumerate(zip(keeper, count)):
        one[holder] = one.get(holder, 0) + n
        chain = chain + n if k and joined[k - 1] else n
        most = max(most, chain)
    return max(most, *one.values())


def _runs(
    keeper: list[int | None], joined: list[bool], count: np.ndarray, closes: np.ndarray, least: int
) -> list[tuple[int, int]]:
    """First and last unit of what goes: runs of repeated units with enough words, enough of them together earlier,
    and of other runs the whole lines that stand together earlier."""
    repeated = np.array([k is not None for k in keeper], dtype=np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated, [0]])))
    out, size = [], count.tolist()
    for s, e in edge.reshape(-1, 2).tolist():
        total = sum(size[s:e])
        if total >= least and _shared(keeper[s:e], joined[s : e - 1], size[s:e]) >= min(least, LEAST_SHARED):
            out.append((s, e - 1))
            continue
        first = s if s == 0 or closes[s - 1] else None
        for u in range(s, e):
            if not closes[u]:
                continue
            if first is not None:
                n, alone = sum(size[first : u + 1]), len(set(keeper[first : u + 1])) == 1
                if n >= min(least, LEAST_LINE) and (alone or all(joined[first:u])):
                    if out and out[-1][1] == first - 1:
                        out[-1] = (out[-1][0], u)
                    else:
                        out.append((first, u))
            first = u + 1
    return out


def _removed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()),
                       ("kept_in", pa.list_(pa.int64()))])
    for batch in batches:
        ids, found, rows = batch.column("doc_id"), batch.column("earlier"), []
        for low, high, data, offsets in words.slices(batch.column("text")):
            row, start, end, count, a, _, closes = units(data, offsets)
            bound = np.searchsorted(row, np.arange(high - low + 1))
            for k in range(high - low):
                s, e = bound[k], bound[k + 1]
                earlier = found[low + k].as_py() or []
                holder = {x["unit"]: x["holder"] for x in earlier if x["holder"] is not None}
                together = {x["unit"] for x in earlier if x["joined"]}
                own, size, first, keeper = a[s:e].tolist(), count[s:e], set(), [None] * (e - s)
                pairs, joined = set(), [False] * (e - s)
                for u, value in enumerate(own):
                    keeper[u] = holder.get(u, ids[low + k].as_py() if value in first else None)
                    first.add(value)
                    pair = (value, own[u + 1]) if u + 1 < len(own) else None
                    joined[u] = u in together or pair in pairs
                    pairs.add(pair)
                runs = _runs(keeper, joined, size, closes[s:e], least)
                if not runs:
                    continue
                whole = data[offsets[k] : offsets[k + 1]].tobytes()
                spans, rest, at, chars, kept_in = [], [], 0, 0, set()
                for f, l in runs:
                    x, y = int(start[s + f] - offsets[k]), int(end[s + l] - offsets[k])
                    before, inside = whole[at:x].decode(), whole[x:y].decode()
                    rest.append(before)
                    keepers = sorted({h for h in keeper[f : l + 1] if h is not None})
                    chars += len(before)
                    spans.append({"start": chars, "end": chars + len(inside), "n_words": int(size[f : l + 1].sum()),
                                  "kept_in": keepers})
                    chars += len(inside)
                    kept_in.update(keepers)
                    at = y
                rest.append(whole[at:].decode())
                rows.append((ids[low + k].as_py(), int(size.sum()), sum(x["n_words"] for x in spans), "".join(rest),
                             spans, sorted(kept_in)))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, [
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(kinds), pa.list_(pa.int64())
            ])],
            ["doc_id", "n_words", "n_removed", "text", "removed", "kept_in"],
        )


def repeats_removed(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """The documents that lose repeated passages: doc_id, n_words, n_removed (words), text (what stays, in order),
    removed (spans of code points of the original text, their words, and the doc_ids that keep them) and kept_in.

    Documents that are not in the result lose nothing. A passage that a document repeats itself goes but for its first
    place. Rows that repeat a doc_id are one document and each give a row. Null and empty texts lose nothing; a null
    doc_id takes no part. Columns other than doc_id and text are not looked at. No rows give no rows.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    digests = rows.mapInArrow(_digests, "doc_id long, text_hash long, unit int, a long, b long")
    holders = digests.groupBy("a", "b").agg(
        F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")
    ).where("holder <> last").drop("last")
    # Only repeated units can have repeated neighbours; the smallest doc_id keeps a pair as it keeps a unit.
    repeated = written(digests.join(holders, ["a", "b"]), "repeated")
    place = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    following = F.when(F.lead("unit").over(place) == F.col("unit") + 1, F.struct(F.lead("a").over(place), F.lead("b").over(place)))
    # Equal rows of a document have each place twice; one is enough.
    once = repeated.dropDuplicates(["doc_id", "text_hash", "unit"]).withColumn("next", following)
    marked = written(once.select(
        "doc_id", "text_hash", "unit", "holder", F.when(F.col("next").isNotNull(), F.xxhash64("a", "b", "next")).alias("pair")
    ), "marked")
    pairs = marked.where("pair IS NOT NULL").groupBy("pair").agg(
        F.min("doc_id").alias("pair_holder"), F.max("doc_id").alias("pair_last")
    ).where("pair_holder <> pair_last").drop("pair_last")
    single = marked.where("doc_id <> holder").select("doc_id", "text_hash", "unit", "holder", F.lit(False).alias("joined"))
    double = marked.join(pairs, "pair").where("doc_id <> pair_holder").select(
        "doc_id", "text_hash", "unit", F.lit(None).cast("long").alias("holder"), F.lit(True).alias("joined")
    )
    earlier = single.unionByName(double).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("unit", "holder", "joined")).alias("earlier")
    )
    joined = rows.join(earlier, ["doc_id", "text_hash"], "left").select("doc_id", "text", "earlier")
    return joined.mapInArrow(lambda batches: _removed(batches, least_run), REMOVED)
