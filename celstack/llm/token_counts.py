"""Token counts of whole texts by a compiled finite-state transducer over characters.

The model is a BPE model of the ``sentencepiece`` library with byte fallback. Its encoding of every prefix of a text ends in exactly
one token, and two tokens may stand side by side only if encoding their joined characters gives the two again. So the token that
ends a longer prefix follows from the open starts: positions from which the characters read so far are a proper prefix of a token,
each with its place in the token trie, the token before it and the number of tokens up to it, relative to the number up to now.
That is a state; pieces are short, so there are finitely many. Reading a character leads to the next state and *changes the number
of tokens* by an amount that the transition carries (it is negative where a character joins several tokens into one). States and
transitions are determinised as they are met, and forgotten when there are too many.

A text is cut into chunks. The map of a chunk takes an entry state to (exit state, tokens). It is computed ahead for the state that
the characters just before the chunk lead to from scratch: nearly always the true one, since a word boundary or a character outside
the vocabulary leaves one state only. Maps compose associatively; a doubling scan over the chunks gives the tokens before the end of
every chunk, and a map that is asked for another entry state extends itself by running its chunk from there. So the result never
depends on the guess.

Defined cases: a null or empty text has no tokens; control names inside a text (``<s>``) are ordinary characters, as in the library; a
null or repeated ``doc_id`` is counted row by row; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
MANY_STATES = 1 << 17
CHUNK = 8192
FEW = 128
LEAD_IN = 48
NORMAL = 1


class State(dict):
    """Transitions by character: (next state, change of the number of tokens); missing ones are worked out on first use."""

    __slots__ = ("machine", "starts")

    def __init__(self, machine: Machine, starts: tuple) -> None:
        super().__init__()
        self.machine, self.starts = machine, starts

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.move(self.starts, char)
        return step


class Machine:
    """The transducer of a BPE vocabulary: ``ranks`` of its pieces, lowest first to join."""

    def __init__(self, ranks: dict[str, int], many_states: int = MANY_STATES) -> None:
        self.ranks, self.many = ranks, many_states
        self.children: list[dict[str, int]] = [{}]
        self.token_at: list[str | None] = [None]
        self.parts: dict[str, tuple[str, str]] = {}
        for token in ranks:
            if len(token) > 1:
                parts: list[tuple[str, str]] = []
                if self.joined(token, parts) != [token]:
                    continue  # never the outcome of encoding
                if any(len(part) > 1 and ranks[part] > ranks[token] for part in parts[-1]):
                    raise ValueError(f"{token!r} ranks before its own parts")  # the order of joins that stay_apart goes by
                self.parts[token] = parts[-1]
            node = 0
            for char in token:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.token_at.append(None)
                node = self.children[node][char]
            self.token_at[node] = token
        self.below: list[list[str] | None] = [None] * len(self.children)
        self._tokens_below()
        self.apart: dict[tuple[str, str], bool] = {}
        self.futures: dict[tuple[int, str], str | None] = {}
        self.likes: dict[tuple[int, tuple], str] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; those still held elsewhere go on working."""
        self.number: dict[tuple, State] = {}
        self.start = self.state(((0, None, 0),))

    def joined(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Encoding of a few characters: the adjacent pair of the lowest rank is joined, leftmost first; ``steps`` gets the pairs."""
        parts, none = list(text), len(self.ranks) + 1
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranked)
            if low == none:
                break
            i = ranked.index(low)
            if steps is not None:
                steps.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether encoding ``left + right`` gives these two tokens."""
        return left + right not in self.ranks and self.came_apart(left, right)

    def came_apart(self, left: str, right: str) -> bool:
        """Whether the two tokens could be made without a join across their border.

        Seen backwards, the later made of the two falls into its parts; while the inner part lay at the border, no join across it
        may have come before the join of the parts, and of equal ranks the left one comes first. What is left is the same question
        about an earlier pair, which many tokens share.
        """
        known = self.apart.get((left, right))
        if known is None:
            ranks, none = self.ranks, len(self.ranks)
            a, b = ranks[left] if len(left) > 1 else -1, ranks[right] if len(right) > 1 else -1
            if a > b:
                inner = self.parts[left][1]
                known = ranks.get(inner + right, none) >= a and self.came_apart(inner, right)
            elif b >= 0:
                inner = self.parts[right][0]
                known = ranks.get(left + inner, none) > b and self.came_apart(left, inner)
            else:
                known = True
            if len(self.apart) >= 4 * self.many:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def _tokens_below(self) -> None:
        """For trie nodes with few longer tokens, those tokens."""
        for node in range(len(self.children) - 1, -1, -1):  # children are numbered after their parents
            found: list[str] = []
            for child in self.children[node].values():
                more = self.below[child]
                if more is None:
                    found = None
                    break
                found += more + ([self.token_at[child]] if self.token_at[child] is not None else [])
                if len(found) > FEW:
                    found = None
                    break
            self.below[node] = found

    def future(self, node: int, before: str) -> str | None:
        """A token that may stand for ``before`` in an open start: the first one met that goes with the same longer tokens. None if
        it goes with none of them, so that the start is dead."""
        longer = self.below[node]
        if longer is None:
            return before
        key = (node, before)
        if key not in self.futures:
            if len(self.futures) >= 4 * self.many:
                self.futures.clear()
                self.likes.clear()
            apart, ranks, known = self.came_apart, self.ranks, self.apart.get
            goes = tuple(t for t in longer if (known((before, t)) is not False) and before + t not in ranks and apart(before, t))
            self.futures[key] = self.likes.setdefault((node, goes), before) if goes else None
        return self.futures[key]

    def state(self, starts: tuple) -> State:
        known = self.number.get(starts)
        if known is None:
            if len(self.number) >= self.many:
                self.reset()
            known = self.number[starts] = State(self, starts)
        return known

    def move(self, starts: tuple, char: str) -> tuple[State, int]:
        """Starts are (trie node, token before or None, tokens up to it less tokens up to now)."""
        if char not in self.children[0]:
            return self.start, len(char.encode("utf-8", "surrogatepass"))  # one token a byte; nothing joins across it
        on, ended = [], None
        for node, before, behind in starts:
            node = self.children[node].get(char)
            if node is None:
                continue
            token = self.token_at[node]
            if ended is None and token is not None and (before is None or self.stay_apart(before, token)):
                ended = (token, behind + 1)
            if self.children[node] and (before is None or (before := self.future(node, before)) is not None):
                on.append((node, before, behind))
        if ended is None:
            raise ValueError(f"no token ends the text at {char!r}")
        token, change = ended
        return self.state((*((n, b, behind - change) for n, b, behind in on), (0, token, 0))), change

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Exit state and tokens of ``text`` read from ``state``."""
        tokens = 0
        for char in text:
            state, change = state[char]
            tokens += change
        return state, tokens


class ChunkMap:
    """Entry state to (exit state, tokens) of a chunk, known where it has been asked for."""

    def __init__(self, machine: Machine, text: str, start: int, end: int) -> None:
        self.machine, self.text, self.start, self.end = machine, text, start, end
        self.known: dict[int, tuple[State, State, int]] = {}
        self.guess = machine.run(machine.start, text[max(0, start - LEAD_IN) : start])[0]
        self(self.guess)

    def __call__(self, entry: State) -> tuple[State, int]:
        found = self.known.get(id(entry))
        if found is None:
            # the entry state is held beside its result, so its id stays its own
            found = self.known[id(entry)] = (entry, *self.machine.run(entry, self.text[self.start : self.end]))
        return found[1], found[2]


class Composed:
    """One map after another, with their own known entries."""

    def __init__(self, first: ChunkMap | Composed, second: ChunkMap | Composed) -> None:
        self.first, self.second, self.guess = first, second, first.guess
        self.known: dict[int, tuple[State, State, int]] = {}
        self(self.guess)

    def __call__(self, entry: State) -> tuple[State, int]:
        found = self.known.get(id(entry))
        if found is None:
            middle, before = self.first(entry)
            last, after = self.second(middle)
            found = self.known[id(entry)] = (entry, last, before + after)
        return found[1], found[2]


def scan(maps: list) -> list:
    """Inclusive prefix compositions in log rounds; within a round, all compositions are independent."""
    step = 1
    while step < len(maps):
        maps = [m if i < step else Composed(maps[i - step], m) for i, m in enumerate(maps)]
        step *= 2
    return maps


class Counter:
    """Token counts of whole texts under a model file."""

    def __init__(self, path: str = MODEL, many_states: int = MANY_STATES, chunk: int = CHUNK) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normalizer, trainer = model.normalizer_spec, model.trainer_spec
        plain = normalizer.name == "identity" and normalizer.escape_whitespaces and not normalizer.remove_extra_whitespaces
        if not (plain and trainer.byte_fallback and trainer.model_type == trainer.BPE and not trainer.treat_whitespace_as_suffix):
            raise ValueError("only BPE models with byte fallback and the identity normalizer are compiled")
        pieces = sorted((-p.score, i, p.piece) for i, p in enumerate(model.pieces) if p.type == NORMAL)
        self.machine = Machine({piece: rank for rank, (_, _, piece) in enumerate(pieces)}, many_states)
        self.prefix, self.chunk = SPACE if normalizer.add_dummy_prefix else "", chunk

    def before_chunks(self, text: str | None) -> list[int]:
        """Tokens up to the end of each chunk of the text with its leading mark."""
        if not text:
            return [0]
        marked = self.prefix + text.replace(" ", SPACE)
        if len(marked) <= self.chunk:
            return [self.machine.run(self.machine.start, marked)[1]]
        maps = [ChunkMap(self.machine, marked, s, min(s + self.chunk, len(marked))) for s in range(0, len(marked), self.chunk)]
        return [m(maps[0].guess)[1] for m in scan(maps)]

    def __call__(self, text: str | None) -> int:
        return self.before_chunks(text)[-1]


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    """One counter for each Python worker: later tasks find the states of earlier ones."""
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 4096, path: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: ``over_limit`` where there are more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = batch.column("text")
            tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
