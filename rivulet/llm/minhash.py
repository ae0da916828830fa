"""Near-duplicate documents by min-max hashing.

Every shingle is hashed once per permutation and both the smallest and the largest value are kept, so a signature of
2 x ``PERMUTATIONS`` rows costs half the hash evaluations. Both ends agree between two documents with the probability
of their Jaccard similarity, and they vary less together than two minima would, since a shingle cannot be both ends of
a larger set. Bands hold rows of one end from different permutations.

With ``ROWS`` = 4 and 28 bands a pair at the threshold of 0.8 meets in no band once in 2.6 million times, more similar
pairs far more rarely. The only other chance is step 3's refutation by signature, six standard deviations off. Every pair that meets in a band ends up linked or
refuted on its full shingle sets, or is already in one class:

1. Documents with equal word sequences are one representative (the smallest id), however many copies there are.
2. In each band bucket all representatives are compared with ``CENTERS`` of them: the smallest id, and others that a
   hash picks. This leaves most classes whole.
3. Buckets that still hold different classes are dealt out in pairs of blocks of bounded size. A task compares what is
   in different classes, by signature and size first and then on full shingle sets, and joins classes as it goes; it
   returns no more links than it has documents. Pairs within a class, or that met in an earlier band, are not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rivulet.llm import words
from rivulet.llm.components import components, written

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 56
ROWS = 4
BLOCK = 512
CENTERS = ("c0", "c1", "c2")
SEED = 20240501
SIGNED = "doc_id long, seq_a long, seq_b long, n_shingles long, bands array<long>, sketch binary"
ROOM = 1 << 23


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(
        0, 1 << 63, count, dtype=np.uint64
    )


def signature_rows(values: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """Minima, then maxima, of every permutation over each run of shingle hashes; runs are not empty."""
    factors, shifts = _permutations(permutations)
    out = np.empty((2 * permutations, len(first)), dtype=np.uint64)
    for k in range(permutations):
        turned = (values ^ shifts[k]) * factors[k]
        turned ^= turned >> np.uint64(31)
        turned *= words._SCRAMBLE
        np.minimum.reduceat(turned, first, out=out[k])
        np.maximum.reduceat(turned, first, out=out[permutations + k])
    return out


def _signed(batches: Iterator[pa.RecordBatch], size: int, permutations: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in words.slices(batch.column("text")):
            hashes, first = words.word_hashes(data, offsets)
            sets, sequences = [], []
            lower = words.lower_ascii(data)
            for k in range(high - low):
                own = hashes[first[k] : first[k + 1]]
                sets.append(np.unique(words.shingles(own, size)))
                sequence = b" ".join(lower[offsets[k] : offsets[k + 1]].tobytes().split())
                sequences.append(hashlib.blake2b(sequence, digest_size=16).digest())
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(counts)
            bands = np.zeros((high - low, 2 * permutations // rows), dtype=np.uint64)
            sketch = np.zeros((high - low, 2 * permutations), dtype=np.uint8)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                signature = signature_rows(np.concatenate([sets[k] for k in full]), starts, permutations)
                sketch[full] = (signature >> np.uint64(13)).astype(np.uint8).T
                for b in range(bands.shape[1]):
                    bands[full, b] = words.combine(list(signature[b * rows : (b + 1) * rows]))
            digests = np.frombuffer(b"".join(sequences), dtype="<i8").reshape(-1, 2)
            width = bands.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(low, high - low).cast(pa.int64()),
                pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(counts),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(high - low + 1, dtype=np.int32) * width),
                    pa.array(words.signed(bands.reshape(-1))),
                ),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
            ], names=["doc_id", "seq_a", "seq_b", "n_shingles", "bands", "sketch"])


def shingle_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The full set of distinct shingles, as words."""
    own = text.encode().lower().split()
    size = min(size, len(own))
    return set(zip(*(own[k:] for k in range(size)))) if own else set()


def _alike(a: set, b: set, threshold: float) -> bool:
    shared = len(a & b)
    return 100 * shared >= round(100 * threshold) * (len(a) + len(b) - shared)


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, threshold: float) -> Iterator[pa.RecordBatch]:
    known, known_set = None, set()
    for batch in batches:
        us, vs, keep = batch.column("u").to_pylist(), batch.column("v").to_pylist(), []
        for k, u in enumerate(us):
            if u != known:
                known, known_set = u, shingle_set(batch.column("text_u")[k].as_py() or "", size)
            if _alike(known_set, shingle_set(batch.column("text_v")[k].as_py() or "", size), threshold):
                keep.append(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([us[k] for k in keep], pa.int64()), pa.array([vs[k] for k in keep], pa.int64())], ["u", "v"]
        )


def confirm(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of the pairs (u, v), those whose full shingle sets reach the threshold."""
    joined = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    joined = joined.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    return joined.select("u", "v", "text_u", "text_v").mapInArrow(
        lambda batches: _confirmed(batches, size, threshold), "u long, v long"
    )


def _block_links(table: pa.Table, size: int, threshold: float) -> pa.Table:
    """Links between the classes of one pair of blocks, as few as join what belongs together.

    Two sets at the threshold agree in that share of the signature rows on average; six standard deviations below it
    is where a pair counts as refuted. Sizes alone refute more. What is left is compared on full sets.
    """
    home, away, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
    ids, block = table.column("rep").to_numpy(), table.column("block").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    bands = np.array(table.column("bands").to_pylist(), dtype=np.int64).reshape(len(ids), -1)[:, :band]
    kind = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    center = np.isin(ids, [table.column(c)[0].as_py() for c in CENTERS])
    sets = []
    for _, _, data, offsets in words.slices(table.column("text")):
        hashes, first = words.word_hashes(data, offsets)
        sets += [np.unique(words.shingles(hashes[s:e], size)) for s, e in zip(first[:-1], first[1:])]
    count = np.array([len(own) for own in sets])
    rows = sketch.shape[1]
    least = threshold * rows - 6 * np.sqrt(threshold * (1 - threshold) * rows)
    left, right = np.flatnonzero((block == home) & ~center), np.flatnonzero((block == away) & ~center)
    us, vs = [], []
    for a in left:
        others = right if home != away else right[right > a]
        others = others[kind[others] != kind[a]]
        low, high = np.minimum(count[others], count[a]), np.maximum(count[others], count[a])
        others = others[low >= threshold * high - 1e-9]
        others = others[(sketch[others] == sketch[a]).sum(axis=1) >= least]
        others = others[~(bands[others] == bands[a]).any(axis=1)]
        for b in others[np.argsort(-(sketch[others] == sketch[a]).sum(axis=1), kind="stable")]:
            if kind[b] == kind[a]:
                continue
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * shared >= round(100 * threshold) * (count[a] + count[b] - shared):
                us.append(min(ids[a], ids[b]))
                vs.append(max(ids[a], ids[b]))
                kind[kind == kind[b]] = kind[a]
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _rest(
    members: DataFrame, reps: DataFrame, texts: DataFrame, classes: DataFrame, size: int, threshold: float
) -> DataFrame:
    """Links between representatives that share a bucket and are in different classes after the first round."""
    placed = members.join(classes, members.rep == classes.u, "left").select(
        members["*"], F.coalesce("v", "rep").alias("component")
    )
    open_buckets = placed.groupBy("band", "bucket").agg(
        F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("m > 2 AND low <> high").select("band", "bucket", "m")
    rows = placed.join(open_buckets, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(SEED)), "blocks")
    )
    known = reps.select("rep", "sketch", "bands").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    # Every block meets itself and each other block once; a row takes part in all meetings of its block.
    mates = rows.join(known, "rep").withColumn(
        "mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).select(
        "band", "bucket", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"), "block", "rep",
        "component", "sketch", "bands", "text", *CENTERS,
    )
    return mates.groupBy("band", "bucket", "i", "j").applyInArrow(
        lambda table: _block_links(table, size, threshold), "u long, v long"
    ).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is that one).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case; with fewer words than ``shingle`` the
    whole sequence is the only shingle. Null and empty texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id each give a row and are one document, linked by any of its texts. A null doc_id is linked with
    nothing and its component is null. Other columns of ``docs`` are not looked at. No rows give no rows.
    """
    signed = written(docs.select("doc_id", "text").mapInArrow(
        lambda batches: _signed(batches, shingle, permutations, rows), SIGNED
    ), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    copies = known.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("rep"))
    reps = known.join(
        copies, (known.doc_id == copies.rep) & (known.seq_a == copies.seq_a) & (known.seq_b == copies.seq_b), "left_semi"
    ).dropDuplicates(["doc_id", "seq_a", "seq_b"]).withColumnRenamed("doc_id", "rep")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    picked = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(c) for k, c in enumerate(CENTERS[1:])]
    shared = banded.groupBy("band", "bucket").agg(
        F.min("rep").alias(CENTERS[0]), *picked, F.count("*").alias("m")
    ).where("m > 1")
    members = written(banded.join(shared.drop("m"), ["band", "bucket"]).distinct(), "buckets")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(
        docs.select("doc_id", "text").join(involved, "doc_id", "left_semi").distinct(), "texts"
    )
    pairs = members.select("rep", F.explode(F.array_distinct(F.array(*CENTERS))).alias("center")).where(
        "rep <> center"
    ).select(F.least("rep", "center").alias("u"), F.greatest("rep", "center").alias("v")).distinct()
    several = known.join(copies, ["seq_a", "seq_b"]).groupBy("doc_id").agg(
        F.min("rep").alias("u"), F.collect_set("rep").alias("reps")
    ).where("size(reps) > 1").select("u", F.explode("reps").alias("v"))
    links = written(confirm(pairs, texts, shingle, threshold).unionByName(several), "confirmed")
    classes = components(links)
    more = written(_rest(members, reps, texts, classes, shingle, threshold), "links")
    if not more.isEmpty():
        # The classes stand for the links of the first round.
        classes = components(classes.unionByName(more))
    groups = copies.join(classes, copies.rep == classes.u, "left").select(
        "seq_a", "seq_b", F.coalesce("v", "rep").alias("group")
    )
    placed = signed.select("doc_id", "n_shingles", "seq_a", "seq_b").join(groups, ["seq_a", "seq_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def unique_documents(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id, with its columns.

    Reads doc_id and text; all columns come back as they were, whatever their names. Of rows with one doc_id the first
    by text stays. Rows with a null doc_id stay, and so do null, empty and blank texts, which are like nothing. No rows
    give no rows.
    """
    named = docs.where("doc_id IS NOT NULL")
    kept = near_duplicates(named.select("doc_id", "text"), shingle, threshold).where("kept").select(
        F.col("doc_id").alias("id")
    ).distinct()
    rows = named.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("own"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("own"))
    unique = rows.join(kept, "id", "left_semi").withColumn("first", first).where("first = 1").select("row.*")
    return unique.unionByName(docs.where("doc_id IS NULL"))
