"""Ranked lexical search of many items over all documents by blocked matrix products.

A block of items has a compact vocabulary: the terms of its own items. One pass over the documents keeps, of every text, its number
of terms and its counts of these terms. From that table come the corpus statistics, and then the scores: item weights (items x
terms) times document impacts (terms x documents), tile by tile, in float64. All factors are integers. The columns of a vocabulary
tile are chosen so that no partial sum of any item can reach 2^53, whatever the documents hold, so each product is exact; tiles
are added up in 64-bit integers. A weight that is itself too large for that is cut into several columns.

Every task keeps the best ``k`` documents of each item and ties go to the smaller ``doc_id`` throughout, so that tiles, tasks and
groups of tasks can be merged in any order. Candidates are merged in two levels: no task sees more than ``k`` rows of an item from
each of some tasks.

Defined cases: a null or empty text has no terms and is not among the counted documents; a row without ``doc_id`` counts in the
statistics but cannot be returned; repeated rows are ranked each for itself; a null or empty item has no results; items with equal
ids are ranked each for itself. Empty tables give an empty result. Only ``doc_id``, ``text`` and ``item_id``, ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .words import blobs, word_slices

#: No impact reaches this: it is 10^9 tf div (1000 tf + 12 m) with m of at least 75.
IMPACT_BOUND = 1_000_000
EXACT = (1 << 53) - 1
TERMS_PER_TILE = 2048
DOCS_PER_TILE = 512
ITEMS_PER_BLOCK, TERMS_PER_BLOCK = 256, 1 << 16
TASKS_PER_GROUP = 64
COUNTS = "doc_id long, n long, ids array<int>, tfs array<int>"


def item_blocks(items: DataFrame, most_items: int = ITEMS_PER_BLOCK, most_terms: int = TERMS_PER_BLOCK) -> Iterator[list[tuple[object, Counter]]]:
    """Items as (item_id, term counts), in blocks of bounded size; only one block is held at a time (an item over the bound is a block)."""
    block, terms = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        counts: Counter = Counter()
        for words in word_slices((row["text"] or "").encode("utf-8", "surrogatepass")):
            counts.update(words)
        if block and (len(block) == most_items or terms + len(counts) > most_terms):
            yield block
            block, terms = [], 0
        block.append((row["item_id"], counts))
        terms += len(counts)
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of every row: its number of terms, and how often each vocabulary term occurs."""
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            lengths, keys, times = [], [], []
            for row, blob in enumerate(blobs(batch.column("text"))):
                n, found = 0, []
                for words in word_slices(blob):
                    n += len(words)
                    found += [k for k in map(get, words) if k is not None]
                    if len(found) > 1 << 20:
                        ids, tf = np.unique(np.array(found, np.int64), return_counts=True)
                        keys.append(ids + row * size)
                        times.append(tf)
                        found = []
                lengths.append(n)
                keys.append(np.array(found, np.int64) + row * size)
                times.append(np.ones(len(found), np.int64))
            keys, place = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            tf = np.bincount(place, np.concatenate(times), len(keys)).astype(np.int32) if len(keys) else np.zeros(0, np.int32)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(lengths) + 1) * size).astype(np.int32))
            ids = pa.array((keys % size).astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


@dataclass(frozen=True)
class Statistics:
    documents: int
    terms: int
    holding: np.ndarray  # documents holding each vocabulary term

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(d) + 1))) for d in self.holding], np.int64)


def statistics(counts: DataFrame, size: int) -> Statistics:
    """Corpus statistics of the counted table; every task sends one row for each vocabulary term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            sums[size] += np.count_nonzero(n)
            sums[size + 1] += n.sum()
            sums[:size] += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=size)[:size]
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], ["key", "times"])

    sums = np.zeros(size + 2, np.int64)
    for row in counts.select("n", "ids").mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times")).collect():
        sums[row["key"]] = row["times"]
    return Statistics(int(sums[size]), int(sums[size + 1]), sums[:size])


@dataclass(frozen=True)
class WeightTiles:
    """Weights of a block's items in column tiles. A column is a vocabulary term; a term may have several columns."""

    items: int
    tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # (columns' terms, entries' items, columns, weights)

    def dense(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for terms, rows, columns, weights in self.tiles:
            tile = np.zeros((self.items, len(terms)))
            tile[rows, columns] = weights
            yield terms, tile


def weight_tiles(block: list[Counter], vocabulary: dict[bytes, int], weights: np.ndarray, width: int = TERMS_PER_TILE, exact: int = EXACT) -> WeightTiles:
    """Columns in tiles of at most ``width`` in which each item's weights sum to at most ``exact`` / impact bound."""
    bound = exact // IMPACT_BOUND
    by_term: dict[int, list[tuple[int, int]]] = {}
    for item, counts in enumerate(block):
        for term, times in counts.items():
            value = times * int(weights[vocabulary[term]])
            if value:
                by_term.setdefault(vocabulary[term], []).append((item, value))
    tiles, terms, entries, sums = [], [], [], Counter()

    def close() -> None:
        if terms:
            rows, columns, values = (np.array(x) for x in zip(*entries, strict=True))
            tiles.append((np.array(terms), rows, columns, values.astype(np.float64)))

    for term in sorted(by_term):
        left = by_term[term]
        while left:  # what is over the bound goes to further columns of the same term
            column = [(item, min(value, bound)) for item, value in left]
            left = [(item, value - bound) for item, value in left if value > bound]
            if len(terms) == width or any(sums[item] + value > bound for item, value in column):
                close()
                terms, entries, sums = [], [], Counter()
            entries += [(item, len(terms), value) for item, value in column]
            terms.append(term)
            sums.update(dict(column))
    close()
    return WeightTiles(len(block), tiles)


def impacts(n: np.ndarray, tf: np.ndarray, row: np.ndarray, stats: Statistics) -> np.ndarray:
    """Impact of each (row, term) entry; the length norm is computed in unbounded integers."""
    norm = np.array([75 + 25 * int(length) * stats.documents // max(1, stats.terms) for length in n], np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm[row])


class Best:
    """The ``k`` best (score, doc_id) of every item so far, scores above 0 only."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros((items, 0), np.int64), np.zeros((items, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (items x documents) of the documents ``ids``. A stable sort of rows in id order leaves ties to the smaller id."""
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        first = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        scores = np.concatenate([self.scores, np.take_along_axis(scores, first, 1)], axis=1)
        ids = np.concatenate([self.ids, ids[first]], axis=1)
        first = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, place = np.nonzero(self.scores > 0)
        return item, self.ids[item, place], self.scores[item, place]


def candidates(counts: DataFrame, tiles: WeightTiles, stats: Statistics, k: int, docs_per_tile: int = DOCS_PER_TILE) -> DataFrame:
    """(item, doc_id, score, task): each task's ``k`` best documents of every item, ``item`` being its place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, dense = Best(tiles.items, k), list(tiles.dense())
        position = np.zeros(len(stats.holding), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, docs_per_tile):
                part = batch.slice(start, docs_per_tile)
                rows = part.num_rows
                lists = part.column("ids")
                row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy()
                value = impacts(part.column("n").to_numpy(), part.column("tfs").flatten().to_numpy(), row, stats).astype(np.float64)
                scores = np.zeros((tiles.items, rows), np.int64)
                held = np.zeros(len(stats.holding), bool)
                held[term] = True
                for terms, weights in dense:
                    used = np.flatnonzero(held[terms])  # columns whose term occurs in this tile of documents
                    if not len(used):
                        continue
                    position[:] = -1
                    position[terms[used]] = np.arange(len(used))
                    inside = position[term] >= 0
                    matrix = np.zeros((len(used), rows))
                    matrix[position[term[inside]], row[inside]] = value[inside]
                    scores += (weights[:, used] @ matrix).astype(np.int64)
                best.add(scores, part.column("doc_id").to_numpy())
        item, doc_id, score = best.rows()
        columns = [pa.array(item, pa.int32()), pa.array(doc_id), pa.array(score), pa.array([TaskContext.get().partitionId()] * len(item), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score", "task"])

    known = counts.where(F.col("doc_id").isNotNull() & (F.size("ids") > 0))
    return known.mapInArrow(run, "item int, doc_id long, score long, task int")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, equal scores by ascending ``doc_id``."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*(counts for _, counts in block))))}
        if not vocabulary:
            continue
        counts = cut(term_counts(docs, vocabulary))
        stats = statistics(counts, len(vocabulary))
        found = candidates(counts, weight_tiles([c for _, c in block], vocabulary, stats.weights()), stats, k)
        order = [F.desc("score"), F.asc("doc_id")]
        group = Window.partitionBy("item", F.floor(F.col("task") / TASKS_PER_GROUP)).orderBy(*order)
        found = found.withColumn("place", F.row_number().over(group)).where(F.col("place") <= k).drop("place")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
