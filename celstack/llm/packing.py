"""Sum-of-squares packing of token sequences into windows of a fixed capacity.

Every task packs the documents it reads online. Whole windows are cut off long documents; the remainder goes to the fill level
that minimises the sum, over all levels, of the squared number of partially filled windows. A level array holds the windows
by their fill, so a placement looks at levels and never at windows. When a task ends (or holds ``open_tokens`` tokens in
partial windows), the open windows are chained, cut at the capacity, and the tail is cut into powers of two: nothing is padded.

Tokens are those of a byte-level BPE vocabulary file of the ``tokenizers`` library. They are computed from the same file by
merge ranks, which gives the same ids about five times faster; special tokens in a text get their ids, as that library does.

Defined cases: a null or empty text is the end token alone; a null or repeated ``doc_id`` is packed row by row; ``start`` counts
inside the row's own tokens. Sequence ids hold the number of the partition in their upper bits and are unique, not dense.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The vocabulary's split pattern with possessive repeats: equal matches, but no backtracking in very long runs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of a text under a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in token): k for token, k in content["model"]["vocab"].items() if token not in special}
        self.own = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self.own.encode_ordinary(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else self.own.encode_ordinary(part)
        return ids


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class LevelArray:
    """Partially filled windows by fill level, and the sum-of-squares rule."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.counts = capacity, np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.held = 0

    def best_level(self, size: int) -> int:
        """Level to add ``size`` to (0: a new window); of equal levels the fullest."""
        counts, last = self.counts, self.capacity - size
        cost = 2 * counts[size:] + 1
        cost[last] = 0
        cost[1:] += 1 - 2 * counts[1 : last + 1]
        cost[1:][counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def place(self, piece, size: int) -> list | None:
        """Put a piece in; the window, if that fills it."""
        level = self.best_level(size)
        window = self.windows[level].pop() if level else []
        self.counts[level] -= level > 0
        self.held += size
        window.append(piece)
        if level + size == self.capacity:
            self.held -= self.capacity
            return window
        self.windows[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def drain(self) -> list:
        """The pieces of all open windows, fullest first; the array is empty afterwards."""
        pieces = [p for level in range(self.capacity, 0, -1) for w in self.windows[level] for p in w]
        self.__init__(self.capacity)
        return pieces


def chain(pieces: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Windows without padding from pieces (row, start, ids): cut at the capacity, the tail into powers of two."""
    left = sum(len(p[2]) for p in pieces)
    room = min(capacity, 1 << (left.bit_length() - 1)) if left else 0
    window: list[tuple] = []
    for row, start, ids in pieces:
        while len(ids):
            take = min(room, len(ids))
            window.append((row, start, ids[:take]))
            ids, start, room, left = ids[take:], start + take, room - take, left - take
            if not room:
                yield window
                window = []
                room = min(capacity, 1 << (left.bit_length() - 1)) if left else 0


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str = VOCABULARY, end_id: int = 0, open_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels = encoder(vocabulary), LevelArray(capacity)
        sequence, out = TaskContext.get().partitionId() << 40, []

        def close(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, total), start, ids in window:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, list(COLUMNS))
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                row, whole = (doc_id, len(ids)), len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    close([(row, start, ids[start : start + capacity])])
                if whole < len(ids) and (full := levels.place((row, whole, ids[whole:].copy()), len(ids) - whole)):
                    close(full)
            if levels.held >= open_tokens:
                for window in chain(levels.drain(), capacity):
                    close(window)
            yield rows()
        for window in chain(levels.drain(), capacity):
            close(window)
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
