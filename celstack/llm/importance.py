"""Resampling of documents towards a target distribution, with weights from bit-sliced counts.

Features (runs of words) fall into buckets by CRC-32. A document's bucket counts are written as bit planes of ``buckets`` bits:
plane j holds bit j of every bucket's count. The buckets' gains, signed integers, are bit planes in two's complement, whose highest
plane counts negatively. The weight of a document, the sum of gains over its features, is then exactly the sum over all pairs of
planes of +-2^(i+j) times the number of bits that both have: AND and popcount over machine words, for many documents at once.

Scores add Gumbel noise from a hash of ``doc_id``; the highest scores are a sample without replacement in proportion to
exp(weight / 1000). The draw is a global order: rows are dealt by ranges of (score, doc_id), numbered in each range, and ranges are
offset by the sizes of the ranges before them, so no task sees more than a range.

Defined cases: a null or empty text has no features, weight 0 and a score; a null ``doc_id`` is hashed as the empty string and comes
last among equal scores; repeated rows are scored and drawn each for itself; an empty target has T = 0; empty documents give an
empty result. Only ``doc_id`` and ``text`` of the documents and ``text`` of the target are read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .words import blobs, word_slices

BUCKETS = 10_000
REMEMBERED = 1 << 19
DOCS_AT_ONCE = 256
ROWS_PER_RANGE = 4_000_000
COUNTED = "doc_id long, n_words long, n_features long, ids array<int>, times array<int>"


class Buckets(dict):
    """Bucket of a feature's bytes; short features are remembered, up to a number of them."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= 32 and len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def _features(blob: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of a text slice by slice; the last words of a slice are kept for runs that cross into the next."""
    tail: list[bytes] = []
    for words in word_slices(blob):
        joined, features = tail + words, list(words)
        for n in range(2, longest + 1):
            start = max(0, len(tail) - n + 1)
            features += [b" ".join(joined[i : i + n]) for i in range(start, len(joined) - n + 1)]
        yield len(words), features
        tail = joined[-(longest - 1) :] if longest > 1 else []


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, ids, times) of every row: its buckets and how many of its features fall into each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(buckets).__getitem__
        for batch in batches:
            words, features, keys = [], [], []
            for row, blob in enumerate(blobs(batch.column("text"))):
                n, m, counts = 0, 0, None
                for some, found in _features(blob, longest):
                    n, m = n + some, m + len(found)
                    ids = np.fromiter(map(bucket, found), np.int64, len(found))
                    counts = np.bincount(ids, minlength=buckets) if counts is None else counts + np.bincount(ids, minlength=buckets)
                words.append(n)
                features.append(m)
                ids = np.flatnonzero(counts)
                keys.append((ids.astype(np.int32), counts[ids].astype(np.int32)))
            offsets = pa.array(np.cumsum([0, *(len(i) for i, _ in keys)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([k[side] for k in keys] or [np.zeros(0, np.int32)]))) for side in (0, 1)]
            columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "ids", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket; a task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column("ids").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[ids])], ["id", "times"])

    totals = np.zeros(buckets, np.int64)
    for row in counted.select("ids", "times").mapInArrow(run, "id long, times long").groupBy("id").agg(F.sum("times").alias("times")).collect():
        totals[row["id"]] = row["times"]
    return totals


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of every bucket, in doubles."""
    s, t, n = own.astype(np.float64), target.astype(np.float64), len(own)
    return np.floor(1000 * np.log((t + 1) * float(own.sum() + n) / ((s + 1) * float(target.sum() + n)))).astype(np.int64)


def _words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class GainPlanes:
    """Gains in two's complement, one plane of bits for each binary digit."""

    def __init__(self, gains: np.ndarray) -> None:
        self.buckets = len(gains)
        width = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
        self.planes = _words_of(np.array([(gains >> i) & 1 for i in range(width)], bool))
        self.scales = np.array([1 << i for i in range(width - 1)] + [-(1 << (width - 1))], np.int64)

    def weights(self, row: np.ndarray, ids: np.ndarray, times: np.ndarray, rows: int) -> np.ndarray:
        """Sum of gains of each of ``rows`` documents; entry e says that document ``row[e]`` has ``times[e]`` features in ``ids[e]``."""
        out = np.zeros(rows, np.int64)
        for j in range(int(times.max(initial=0)).bit_length()):
            has = (times >> j) & 1 == 1
            which, place = np.unique(row[has], return_inverse=True)
            bits = np.zeros((len(which), self.buckets), bool)
            bits[place, ids[has]] = True
            counts = _words_of(bits)
            for plane, scale in zip(self.planes, self.scales, strict=True):
                out[which] += (int(scale) << j) * np.bitwise_count(counts & plane).sum(axis=1, dtype=np.int64)
        return out


def weigh(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every counted row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = GainPlanes(gain)
        for batch in batches:
            weights = []
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                lists = part.column("ids")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                weights.append(planes.weights(row, lists.flatten().to_numpy(), part.column("times").flatten().to_numpy(), part.num_rows))
            columns = [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(np.concatenate(weights or [np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int) -> DataFrame:
    """``score`` = weight plus Gumbel noise from the first 32 bits of sha256(seed:doc_id)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def numbered(rows: DataFrame, order: list, count: int, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3... along ``order``, over all rows and without gathering them."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_PER_RANGE))
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    sizes = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    starts = itertools.accumulate([sizes[r] for r in sorted(sizes)], initial=0)
    before = spark.createDataFrame(list(zip(sorted(sizes), starts, strict=False)), "__range int, __before long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` numbers the drawn ones by falling score and is null for the rest.

    Of the N documents with at least ``min_words`` words, floor(percent N / 100) are drawn.
    """
    counted = cut(bucket_counts(docs, longest, buckets))
    totals = bucket_totals(bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets), buckets)
    scored = with_scores(weigh(counted, gains(bucket_totals(counted, buckets), totals)), seed)
    fit = (F.col("n_words") >= min_words).alias("fit")
    sizes = counted.agg(F.count("*").alias("rows"), F.count(F.when(F.col("n_words") >= min_words, 1)).alias("fit")).first()
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = numbered(scored.select("doc_id", "n_features", "weight", "score", fit), order, sizes["rows"], "rank")
    drawn = F.when(F.col("fit") & (F.col("rank") <= percent * sizes["fit"] // 100), F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
