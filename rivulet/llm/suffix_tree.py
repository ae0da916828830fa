"""Score texts with a probabilistic suffix tree over words.

Nodes are contexts of up to ``DEPTH`` preceding words. A context is a candidate if it occurs at least as often as a
threshold says; next symbols get a distribution of their own in it if the pair occurs often enough. A candidate is
retained if its next-symbol distribution diverges from that of its parent (the context without its farthest word): the
log-likelihood ratio over its occurrences must exceed ``DIVERGENCE`` per symbol of its own. A rejected candidate has no
distribution of its own and stands for its parent, and its own children are still tested. Distributions are smoothed by
absolute discounting; the mass set free goes to the other symbols in proportion to the parent's distribution, down to
the base distribution over all words at the root. So every context's probabilities sum to 1 with unseen words as one
symbol, like the base. A token is scored in the longest retained suffix of its history.

Word counts are exact and complete, and grow with the corpus. The tree grows with it, too: with N training tokens the
thresholds are at most sqrt(N) / ``COMMON`` occurrences for a word to be common and to be a context, sqrt(N) /
``CONTEXT`` for a longer context, and sqrt(N) / ``PAIR`` for a pair, and never more than small shares of N. So the tree
has at most ``CONTEXT`` * sqrt(N) contexts and ``PAIR`` * sqrt(N) pairs a level, 18 million at 5e9 tokens if every token
fell on a pair of just the least count, and can be sent to every task; this is the price of scoring without a shuffle
of all tokens at every level, and phrases rarer than that are scored in shorter contexts. Common words are known to
every task. All other words meet their counts in a shuffle by word, where no key has more rows than a common word has
occurrences; the counts stay where they are, and each document gets back its sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rivulet.llm import words
from rivulet.llm.components import written

DEPTH = 4
COMMON, COMMON_SHARE = 16, 1e-5
CONTEXT, CONTEXT_SHARE = 16, 1e-4
PAIR, PAIR_SHARE = 256, 5e-7
LEAST_PAIR = 3
DIVERGENCE = 1.0
DISCOUNT = 0.5
ADDED = 0.1
HELD_OUT_OF = 10
BUFFERED = 2_000_000
END = np.uint64(0xE0D0E0D0E0D0E0D1)
BEGIN = np.uint64(0xB0B0B0B0B0B0B0B1)


@dataclass
class Tree:
    """The tree as sorted arrays. Symbol k is common word k, the end of a text included; node 0 is the root."""

    symbols: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    # The contexts of one word by that word; then, by level, those of more by (nearer context, farther word).
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    deeper: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    node_parent: list[int] = field(default_factory=lambda: [0])
    alpha: list[float] = field(default_factory=lambda: [1.0])
    pair_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    pair_logs: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)

    def least(self, wanted: int, share: float) -> float:
        """The occurrences that a threshold asks for."""
        return min(share * self.tokens, self.tokens ** 0.5 / wanted)

    def base(self, symbols: np.ndarray) -> np.ndarray:
        return (self.counts[symbols] + ADDED) / self.total


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, token hashes (words and an end per row) and the row of each token."""
    for low, high, data, offsets in words.slices(column):
        hashes, first = words.word_hashes(data, offsets)
        ends = first[1:] + np.arange(high - low)
        out = np.empty(len(hashes) + high - low, dtype=np.uint64)
        is_end = np.zeros(len(out), dtype=bool)
        is_end[ends] = True
        out[is_end], out[~is_end] = END, hashes
        yield low, high, out, np.repeat(np.arange(high - low), np.diff(first) + 1)


def _counted(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    """Counts of the keys that ``keys(tokens, rows)`` gives, summed over some millions of tokens at a time."""

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.signed(values)), pa.array(counts)], ["key", "n"])

    held, size = [], 0
    for batch in batches:
        for _, _, tokens, rows in _tokens(batch.column("text")):
            own = keys(tokens, rows)
            held.append(own)
            size += len(own)
            if size >= BUFFERED:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _history(symbols: np.ndarray, rows: np.ndarray, back: int, begin: int) -> np.ndarray:
    """Symbol ``back`` tokens before each token; ``begin`` just before a text, -1 farther back or for rare words."""
    out = np.full(len(symbols), -1, dtype=np.int64)
    out[back:] = np.where(rows[back:] == rows[:-back], symbols[:-back], -1)
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    at = start + back - 1
    at = at[(at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == rows[start])]
    out[at] = begin
    return out


def _nodes(tree: Tree, symbols: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """The deepest node, down to ``depth``, of each token's history."""
    begin = len(tree.symbols)
    previous = _history(symbols, rows, 1, begin)
    found = np.where(previous >= 0, tree.first[previous], 0) if len(tree.first) else np.zeros(len(rows), np.int64)
    reached = found
    for back, (keys, nodes) in enumerate(tree.deeper[: depth - 1], 2):
        before = _history(symbols, rows, back, begin)
        at = _find(keys, np.where((reached > 0) & (before >= 0), reached * (begin + 1) + before, -1))
        # Only a context that was reached in full has longer ones.
        reached = np.where(at >= 0, nodes[at], 0) if len(nodes) else np.zeros(len(rows), np.int64)
        found = np.where(reached > 0, reached, found)
    return found


def _pairs(tree: Tree, depth: int, floor: int):
    """Key function: node of exactly ``depth`` (those from ``floor`` on) x symbols + symbol, for common symbols."""

    def keys(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
        symbols = _find(tree.symbols, tokens)
        nodes = _nodes(tree, symbols, rows, depth)
        own = (symbols >= 0) & (nodes >= floor)
        return nodes[own] * len(tree.symbols) + symbols[own]

    return keys


def _grow(tree: Tree, pairs: np.ndarray, counts: np.ndarray, seen: np.ndarray, floor: int, divergence: float) -> None:
    """Give the candidate nodes from ``floor`` on that pass the divergence test their distributions.

    ``pairs`` are sorted; ``seen`` has the occurrences of each candidate.
    """
    if not len(pairs):
        return
    width = len(tree.symbols)
    node, symbols = pairs // width, pairs % width
    heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    each = np.diff(np.append(heads, len(pairs)))
    total = np.repeat(seen[node[heads] - floor], each)
    parent = 10.0 ** _log_probability(tree, np.array(tree.node_parent)[node], symbols)
    own = (counts - DISCOUNT) / total
    rest = 1 - np.add.reduceat(own, heads)
    parent_rest = np.maximum(1 - np.add.reduceat(parent, heads), 1e-12)
    others = np.maximum(total[heads] - np.add.reduceat(counts, heads), 0)
    gain = np.add.reduceat(counts * np.log(own / parent), heads) + others * np.log(rest / parent_rest)
    kept = gain >= divergence * (each + 1)
    alpha = np.array(tree.alpha)
    alpha[node[heads][kept]] = (rest / parent_rest)[kept]
    tree.alpha = alpha.tolist()
    new = np.repeat(kept, each)
    # Nodes are numbered level by level, so the keys stay sorted.
    tree.pair_keys = np.concatenate([tree.pair_keys, pairs[new]])
    tree.pair_logs = np.concatenate([tree.pair_logs, np.log10(own[new])])


def _longer(tree: Tree, paths: np.ndarray, pairs: np.ndarray, counts: np.ndarray, floor: int, end: int):
    """The contexts that the pairs of one level are, often enough, for the next level.

    ``paths`` has the words of each node of the level, the nearest first. Gives key (nearer context, farther word),
    parent, path and occurrences of each, by key.
    """
    width = len(tree.symbols)
    often = (counts >= tree.least(CONTEXT, CONTEXT_SHARE)) & (pairs % width != end)
    path = np.column_stack([pairs[often] % width, paths[pairs[often] // width - floor]])
    parent = tree.first[path[:, 0]]
    for depth, (keys, nodes) in enumerate(tree.deeper, 1):
        at = _find(keys, parent * (width + 1) + path[:, depth])
        parent = np.where((parent > 0) & (at >= 0), nodes[at] if len(nodes) else 0, 0)
    known = parent > 0
    key = parent[known] * (width + 1) + path[known, -1]
    order = np.argsort(key)
    return key[order], parent[known][order], path[known][order], counts[often][known][order]


def _log_probability(tree: Tree, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """log10 P(symbol | node) for common symbols."""
    out, open_, nodes = np.zeros(len(nodes)), np.ones(len(nodes), dtype=bool), nodes.copy()
    alpha, parents = np.log10(np.array(tree.alpha)), np.array(tree.node_parent)
    while open_.any():
        at = _find(tree.pair_keys, nodes * len(tree.symbols) + symbols)
        own = open_ & (nodes > 0) & (at >= 0)
        out[own] += tree.pair_logs[at[own]]
        root = open_ & (nodes == 0)
        out[root] += np.log10(tree.base(symbols[root]))
        open_ &= ~own & ~root
        out[open_] += alpha[nodes[open_]]
        nodes[open_] = parents[nodes[open_]]
    return out


def _way_down(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    """Factor (log10) on the base probability of words that no node has a distribution for."""
    alpha, down = np.log10(np.array(tree.alpha)), np.zeros(len(tree.alpha))
    for node in range(1, len(down)):
        down[node] = alpha[node] + down[tree.node_parent[node]]
    return down[nodes]


def learn(training: DataFrame, divergence: float = DIVERGENCE) -> Tree:
    """The tree of the whole texts of ``training``."""

    def counts(keys) -> DataFrame:
        found = training.select("text").mapInArrow(lambda batches: _counted(batches, keys), "key long, n long")
        return found.groupBy("key").agg(F.sum("n").alias("n"))

    vocabulary = written(counts(lambda tokens, rows: tokens), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = Tree(np.zeros(0, np.uint64), np.zeros(0, np.int64), tokens, distinct)
    common = vocabulary.where(F.col("n") >= tree.least(COMMON, COMMON_SHARE)).toArrow()
    symbols, n = common["key"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(symbols)
    tree.symbols, tree.counts = symbols[order], n[order]
    if not tokens:
        return tree

    width = len(tree.symbols)
    end = int(_find(tree.symbols, np.array([END]))[0])
    texts = int(vocabulary.where(F.col("key") == int(words.signed(np.array([END]))[0])).first()["n"])
    # One word of context: the common words but the end, and the beginning of a text, whose number is len(symbols).
    often = np.flatnonzero(tree.counts >= tree.least(CONTEXT, CONTEXT_SHARE))
    paths = np.append(often[often != end], width)[:, None]
    seen = np.append(tree.counts[paths[:-1, 0]], texts)
    tree.first = np.zeros(width + 1, dtype=np.int64)
    tree.first[paths[:, 0]] = np.arange(1, len(paths) + 1)
    tree.node_parent += [0] * len(paths)
    tree.alpha += [1.0] * len(paths)
    floor = 1
    for depth in range(1, DEPTH + 1):
        shared = training.sparkSession.sparkContext.broadcast(tree)
        found = training.select("text").mapInArrow(
            lambda batches: _counted(batches, _pairs(shared.value, depth, floor)), "key long, n long"
        ).groupBy("key").agg(F.sum("n").alias("n"))
        found = found.where(F.col("n") >= max(tree.least(PAIR, PAIR_SHARE), LEAST_PAIR)).toArrow()
        shared.unpersist()
        pairs, n = found["key"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        _grow(tree, pairs, n, seen, floor, divergence)
        if depth == DEPTH:
            break
        key, parents, paths, seen = _longer(tree, paths, pairs, n, floor, end)
        if not len(key):
            break
        floor = len(tree.alpha)
        tree.deeper.append((key, np.arange(floor, floor + len(key))))
        tree.node_parent += parents.tolist()
        tree.alpha += [1.0] * len(key)
    return tree


OWN = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
SCORED = f"doc_id long, row long, key long, n long, learnt boolean, own struct<{OWN}>"


def _scored(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """A row for each rare word of a text with its number, and one without a number with what common words give."""
    for batch in batches:
        for low, high, tokens, rows in _tokens(batch.column("text")):
            size = high - low
            ids, held, row = (batch.column(c).slice(low, size) for c in ("doc_id", "held_out", "row"))
            symbols = _find(tree.symbols, tokens)
            nodes = _nodes(tree, symbols, rows, DEPTH)
            known = symbols >= 0
            score, base = np.zeros(len(tokens)), np.zeros(len(tokens))
            score[known] = _log_probability(tree, nodes[known], symbols[known])
            score[~known] = _way_down(tree, nodes[~known])
            base[known] = np.log10(tree.counts[symbols[known]] + ADDED)
            own = pa.StructArray.from_arrays([
                ids.cast(pa.int64()), held, pa.array(np.bincount(rows, minlength=size).astype(np.int64)),
                pa.array(np.bincount(rows, known, size).astype(np.int64)), pa.array(np.bincount(rows, base, size)),
                pa.array(np.bincount(rows, score, size)),
            ], ["doc_id", "held_out", "n_tokens", "known", "base", "score"])
            order = np.lexsort((tokens[~known], rows[~known]))
            keys, owner = tokens[~known][order], rows[~known][order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(new)
            number = np.diff(np.concatenate([head, [len(keys)]])).astype(np.int64)
            take = pa.array(np.concatenate([owner[head], np.arange(size)]))
            # The row without a number goes under the text's own hash, as if under a word of its own.
            key = pa.concat_arrays([pa.array(words.signed(keys[head])), row.cast(pa.int64()).combine_chunks()
                                    if isinstance(row, pa.ChunkedArray) else row.cast(pa.int64())])
            yield pa.RecordBatch.from_arrays([
                ids.cast(pa.int64()).take(take), row.take(take), key,
                pa.array(np.concatenate([number, np.zeros(size, dtype=np.int64)])), pc.invert(held).take(take),
                pa.concat_arrays([pa.nulls(len(head), own.type), own]),
            ], ["doc_id", "row", "key", "n", "learnt", "own"])


def scored(docs: DataFrame, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Texts whose crc32(doc_id as text) mod 10 is 0 are held out from learning; a null doc_id counts as the empty text,
    whose remainder is 0. Tokens are words ``[^\\x20\\x09-\\x0D]+`` in A-Z lower case, then one end; a null or empty text is
    an end alone. Rows that repeat a doc_id are learnt from and scored as often as they occur. Without training rows
    every token is unknown and all probability is on that one symbol, so scores are 0. Columns other than doc_id and
    text are not looked at. No rows give no rows. Words are told apart by 64-bit hashes.
    """
    folded = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", (folded % HELD_OUT_OF == 0).alias("held_out"))
    tree = learn(rows.where("NOT held_out").select("text"), divergence)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    # A row is known by its id and text; equal rows are summed together and told apart again at the end.
    marked = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    met = marked.mapInArrow(lambda batches: _scored(batches, shared.value), SCORED).withColumn(
        "c", F.sum(F.when(F.col("learnt"), F.col("n")).otherwise(0)).over(Window.partitionBy("key"))
    )
    sums = met.groupBy("doc_id", "row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + ADDED)).alias("rare_base"), F.sum("n").alias("rare"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.count("own").alias("equal"),
        F.sum("own.n_tokens").alias("n_tokens"), F.sum("own.known").alias("known"),
        F.sum("own.base").alias("base"), F.sum("own.score").alias("score"),
        F.bool_or("own.held_out").alias("held_out"),
    )
    scale = float(np.log10(tree.total))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal"))))
    return each.select(
        "doc_id", "held_out", F.expr("n_tokens div equal").alias("n_tokens"),
        F.expr("(known + rare_known) div equal").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + F.col("rare_base") - F.col("n_tokens") * scale) / F.col("equal")).alias("base_score"),
        ((F.col("score") + F.col("rare_base") - F.col("rare") * scale) / F.col("equal")).alias("score"),
    )
