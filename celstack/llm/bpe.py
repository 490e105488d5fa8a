"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. The BPE encoding of every prefix of a piece ends in exactly one token, and a token can follow another only if the two
stay apart when their bytes are encoded together. So a piece is read byte by byte: a state holds the open starts (positions from
which the bytes read so far are a proper prefix of some token), each with its place in the token trie, the token before it and
the tokens that are not yet certain. Reading a byte moves all starts on, finds the one token that ends the new prefix, opens a
start there, and emits what all open starts have in common; a start closes after at most the length of the longest token, which
bounds the lookahead. States are numbered and their transitions remembered as they occur, up to a number of states.

A piece that is itself a token is that token, as in rank-based encoders. Decoding joins token bytes and runs an incremental UTF-8
state machine that keeps an incomplete character for the next call.

Defined cases: null is the empty text, with no tokens; unpaired surrogates are encoded as their three bytes and decode to
themselves; a null or repeated ``doc_id`` is encoded row by row. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import utf8

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Matches the same pieces as the tokenizers' pattern; possessive repeats keep very long runs from backtracking.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MANY_STATES = 1 << 19
MANY_PIECES = 1 << 19
REMEMBERED_POINTS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Transducer:
    """Pieces to token ids under ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], many_states: int = MANY_STATES) -> None:
        self.ranks, self.many = ranks, many_states
        self.bytes_of = {k: t for t, k in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, k in ranks.items():
            if not self._reachable(token, k):
                continue
            node = 0
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][byte]
            self.token_at[node] = k
        self.apart: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; they come back as they are met."""
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.rest: list[tuple] = []
        self._state(((0, -1, ()),))

    def _reachable(self, token: bytes, k: int) -> bool:
        return len(token) == 1 or self.merge(token) == [k]

    def merge(self, data: bytes) -> list[int]:
        """Encoding of a few bytes by merging the adjacent pair of the lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
            low = min(ranked)
            if low == 1 << 30:
                break
            i = ranked.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _stay_apart(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= self.many * 8:
                self.apart.clear()
            known = self.apart[pair] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _state(self, starts: tuple) -> int:
        """Number of a state; ``starts`` are (trie node, token before, uncertain tokens), oldest first."""
        known = self.number.get(starts)
        if known is None:
            known = self.number[starts] = len(self.states)
            self.states.append(starts)
            self.moves.append({})
            self.rest.append(starts[-1][2])
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        """Next state and the tokens that became certain."""
        starts, ended = [], None
        for node, before, pending in self.states[state]:
            node = self.children[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if ended is None and token >= 0 and (before < 0 or self._stay_apart(before, token)):
                ended = (0, token, (*pending, token))
            if self.children[node]:
                starts.append((node, before, pending))
        if ended is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        starts.append(ended)
        certain, shortest = 0, min(len(s[2]) for s in starts)
        while certain < shortest and len({s[2][certain] for s in starts}) == 1:
            certain += 1
        emitted = ended[2][:certain]
        target = self._state(tuple((n, b, p[certain:]) for n, b, p in starts))
        self.moves[state][byte] = (target, emitted)
        return target, emitted

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > self.many:
            self.reset()
        out: list[int] = []
        state = 0
        for byte in piece:
            step = self.moves[state].get(byte)
            state, emitted = step if step is not None else self._move(state, byte)
            if emitted:
                out += emitted
            if len(self.states) > 2 * self.many:  # one very long piece: restart from the same starts
                starts = self.states[state]
                self.reset()
                state = self._state(starts)
        out += self.rest[state]
        return tuple(out)


class Encoder:
    """Texts to ids; the ids of pieces are remembered up to a number of pieces."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PIECES) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.pieces, self.known = regex.compile(pattern), {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        pieces, known = self.pieces.findall(text), self.known
        if len(known) > MANY_PIECES:
            known.clear()
        fresh = set(pieces).difference(known)
        for piece in fresh:
            known[piece] = self.transducer(utf8(piece))
        ids: list[int] = []
        for piece in pieces:
            ids += known[piece]
        for piece in fresh:
            if len(piece) > REMEMBERED_POINTS:
                del known[piece]
        return np.array(ids, "<u4")


def _utf8_moves() -> list[list[int]]:
    """State machine of UTF-8 with surrogates let through: states 0 complete, 1..3 that many bytes to come, 4..6 first
    continuation of E0, F0, F4 (restricted ranges), 7 an error."""
    moves = [[7] * 256 for _ in range(8)]
    for byte in range(256):
        moves[0][byte] = (0 if byte < 0x80 else 7 if byte < 0xC2 else 1 if byte < 0xE0 else 4 if byte == 0xE0 else 2 if byte < 0xF0
                          else 5 if byte == 0xF0 else 3 if byte < 0xF4 else 6 if byte == 0xF4 else 7)
        if 0x80 <= byte < 0xC0:
            moves[1][byte], moves[2][byte], moves[3][byte] = 0, 1, 2
            moves[4][byte] = 1 if byte >= 0xA0 else 7
            moves[5][byte] = 2 if byte >= 0x90 else 7
            moves[6][byte] = 2 if byte < 0x90 else 7
    return moves


UTF8_MOVES = _utf8_moves()


class StreamDecoder:
    """Token bytes to text; a character cut by the end of a call waits for the next one."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of, self.held = bytes_of, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):  # the last lead byte decides whether the end is an incomplete character
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[len(data) - back :]:
                    state = UTF8_MOVES[state][byte]
                cut = len(data) - back if 0 < state < 7 else len(data)
                break
        self.held = data[cut:]
        return _text(data[:cut])

    def close(self) -> str:
        """What is left at the end of the stream; an incomplete character becomes replacement characters."""
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


def _text(data: bytes) -> str:
    """Whole characters as text; encoded surrogates pass, anything else that is not UTF-8 is replaced."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        try:
            return data.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace")


def decode(ids: np.ndarray, bytes_of: dict[int, bytes], step: int = 4096) -> str:
    decoder = StreamDecoder(bytes_of)
    parts = [decoder.feed(ids[k : k + step].tolist()) for k in range(0, len(ids), step)]
    return "".join(parts) + decoder.close()


@functools.lru_cache(2)
def encoder(path: str, pattern: str = PIECES) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): token ids of the whole text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids = [encode(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids alone."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        bytes_of = encode.transducer.bytes_of
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = encode(text)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(utf8(decode(ids, bytes_of))).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
