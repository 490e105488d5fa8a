"""Line deduplication with two Bloom filters and an exact confirmation of suspected repeats.

1. Every task sets the bits of its line keys in a "seen once" filter, and of keys it meets again in a "seen twice" filter.
   The filters are cut into segments; tasks emit only segments with set bits, compressed, and the segments are merged in a
   shuffle: bits that two tasks have both set once become bits seen twice. No key that occurs twice can be missed.
2. Lines whose key is in the "seen twice" filter are suspects; only their 128-bit digests shuffle. Counting distinct
   documents confirms the repeated keys exactly, whatever false positives the filter has.
3. Confirmed lines are gathered per document and the texts rebuilt.

The filters have a fixed number of bits (a parameter): beyond their capacity more lines become suspects and are shuffled, and
the result stays the same. They are the only data that pass through the driver, at most twice ``bits / 8`` bytes.

Defined cases: a null or empty text is one empty line; keys are compared after stripping and lower-casing ASCII; keys shorter
than ``min_points`` code points are never dropped; documents count by distinct non-null ``doc_id``, so a repeated row counts
once and rows with a null id count for nothing, but all lose their repeated lines alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import utf8

SPACES = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 19
HASHES = 3


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()


def code_points(key: bytes) -> int:
    return sum(byte & 0xC0 != 0x80 for byte in key)


def _long_enough(key: bytes, min_points: int) -> bool:
    return len(key) >= min_points and (min_points <= 1 or code_points(key) >= min_points)


def _keys(text: str | None, min_points: int) -> set[bytes]:
    return {k for k in {line_key(line) for line in utf8(text).split(b"\n")} if _long_enough(k, min_points)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` bit positions per hash, by double hashing; ``bits`` is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)])


class Filter:
    """Seen-once and seen-twice bits of one task; segments are allocated as bits in them are set."""

    def __init__(self, bits: int) -> None:
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Note the keys of one document or more; a key that occurs twice in ``hashes`` counts as seen twice."""
        distinct, counts = np.unique(hashes, return_counts=True)
        again = (counts > 1) | _has(self.once, distinct, self.bits)
        _set(self.twice, distinct[again], self.bits)
        _set(self.once, distinct, self.bits)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = min(SEGMENT_BITS, self.bits) // 8
        for k in range(self.bits // 8 // size):
            once, twice = self.once[k * size : (k + 1) * size], self.twice[k * size : (k + 1) * size]
            if once.any():
                yield k, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def _set(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    at = _positions(hashes, bits).ravel()
    np.bitwise_or.at(filter_bytes, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def _has(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _positions(hashes, bits)
    found = (filter_bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return found.all(axis=0)


def seen_twice(docs: DataFrame, bits: int, min_points: int) -> bytes:
    """The merged "seen twice" filter of all lines, at most ``bits / 8`` bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            found = [_hashes(_keys(t, min_points)) for t in batch.column("text").to_pylist()]
            if found:
                own.add(np.concatenate(found))
        rows = list(own.segments())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                         ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
                if k in held:
                    o, t = held[k]
                    a, b = o | a, t | b | (o & a)
                held[k] = a, b
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(held[k][1].tobytes(), 1) for k in keys], pa.binary())],
                                         ["segment", "twice"])

    built = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary")
    merged = built.repartition("segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    size = min(SEGMENT_BITS, bits) // 8
    for row in merged.collect():
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out.tobytes()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(docs: DataFrame, twice: bytes, bits: int, min_points: int) -> DataFrame:
    """(doc_id, text_id, key): each distinct suspected key of each document once; ``text_id`` tells rows of one id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bytes = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, texts, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = list(_keys(text, min_points))
                hits = [own[i] for i in np.flatnonzero(_has(filter_bytes, _hashes(own), bits))] if own else []
                if hits:
                    ids += [doc_id] * len(hits)
                    texts += [text_id(text)] * len(hits)
                    keys += map(digest, hits)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "text_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, text_id long, key binary")


def text_id(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(utf8(text)) - (1 << 63)


def confirmed(found: DataFrame, min_docs: int) -> DataFrame:
    """(key, first_doc) of the suspects that at least ``min_docs`` documents hold; the first document is the smallest id."""
    once = found.where("doc_id is not null").groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs).drop("n")


def dedupe_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep_first: bool = False, bits: int = 1 << 26) -> DataFrame:
    """``docs`` with its text replaced by the kept lines, plus ``n_lines`` and ``n_dropped``.

    Every line whose key occurs in at least ``min_docs`` documents goes, in all of them; with ``keep_first`` the first line of
    that key in the document with the smallest id stays. Other columns pass through; clashing names are the caller's to avoid.
    """
    if bits & (bits - 1) or bits < 8:
        raise ValueError("bits must be a power of two of at least 8")
    found = cut(suspects(docs, seen_twice(docs, bits, min_points), bits, min_points))
    repeated = cut(confirmed(found, min_docs))
    first = F.when(F.lit(keep_first) & (F.col("doc_id") == F.col("first_doc")), F.col("key"))
    # one row per document that loses lines: digests of its repeated keys, no longer than its own text
    lost = cut(found.join(repeated, "key").groupBy("doc_id", "text_id").agg(
        F.array_join(F.collect_set(F.hex("key")), "").alias("__lost"), F.array_join(F.collect_set(F.hex(first)), "").alias("__first")))

    @F.arrow_udf("long")
    def text_ids(texts: pa.Array) -> pa.Array:
        return pa.array([text_id(t) for t in texts.to_pylist()], pa.int64())

    @F.arrow_udf("struct<text string, n_lines long, n_dropped long>")
    def rebuilt(texts: pa.Array, lost_keys: pa.Array, first_keys: pa.Array) -> pa.Array:
        rows = [rebuild(*x, min_points) for x in zip(texts.to_pylist(), lost_keys.to_pylist(), first_keys.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                          ["text", "n_lines", "n_dropped"])

    own = lost.withColumnsRenamed({"doc_id": "__doc", "text_id": "__text"})
    matched = docs.withColumn("__id", text_ids("text")).join(own, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__id") == F.col("__text")), "left")
    done = matched.withColumn("__new", rebuilt("text", "__lost", "__first"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return done.select(*others, F.col("__new.text").alias("text"), F.col("__new.n_lines").alias("n_lines"), F.col("__new.n_dropped").alias("n_dropped"))


def rebuild(text: str | None, lost: str | None, first: str | None, min_points: int) -> tuple[str, int, int]:
    """Kept text, number of lines, number of dropped lines; ``lost`` and ``first`` are concatenated hex digests."""
    lines = utf8(text).split(b"\n")
    if not lost:
        return text or "", len(lines), 0
    gone, stay = _digests(lost), _digests(first or "")
    kept = []
    for line in lines:
        key = line_key(line)
        if _long_enough(key, min_points) and (own := digest(key)) in gone:
            if own not in stay:
                continue
            stay.remove(own)
        kept.append(line)
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


def _digests(text: str) -> set[bytes]:
    data = bytes.fromhex(text)
    return {data[i : i + 16] for i in range(0, len(data), 16)}
