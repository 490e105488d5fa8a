"""Exact n-gram Jaccard self-join by T-occurrence search, with the components of its links.

1. Signatures. A document is the sorted set of its shingle hashes. Two sets with Jaccard similarity t differ in a bounded number
   of elements, so when the hash range is cut into one part more than that, some part is equal in both. The hash of each part is
   a signature; documents that share none cannot be linked. Sizes fall into intervals so that linked sets lie in the same or the
   next one, and every set emits the parts of both. Signatures travel packed (7 bytes each) and are sorted in the reducers,
   which emit a star of edges for each shared one, never all pairs.
2. Blocks. The documents of a star are compared by the parity of their hashes' counts in ranges (one or two for each element): sets where more ranges differ than
   linked sets can differ in elements are no candidates, which removes documents that merely share a passage. Components of the
   remaining edges hold every link. Sets of a block meet in one task; a block of more than ``block`` sets is cut into chunks.
3. T-occurrence. In a chunk an inverted index maps a shingle to its documents. A query merges its short lists with a heap and
   probes its long lists by binary search (DivideSkip); documents reaching the overlap that the threshold asks for are linked.
   Only connectivity is asked for, so candidates that are already connected are not searched for again.
4. Chunks of one large block are joined exactly: class representatives are linked first; then every set outside the largest class
   of its block queries every chunk of the block.

Equal sets are one node from the start (64-bit digests of the sets), so copies cost nothing after step 1.

Defined cases: null and empty texts, and texts without words, have no shingle and link with nothing; with fewer words than a
shingle has, the whole sequence is the only shingle; a null ``doc_id`` takes part in no link and has a null component; rows
that repeat an id are one document with several texts. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut
from .common import hinted, utf8

FLUSH = 1 << 20
BLOCK = 512
STARS = 32
ROW = np.dtype([("doc", "<i8"), ("n", "<i8"), ("node", "<i8"), ("ref", "<i8")])
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are remembered up to a fixed number of words."""

    def __init__(self, size: int, remembered: int = 1 << 18) -> None:
        self.size, self.remembered, self.words = size, remembered, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = utf8(text).lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
        known = self.words
        if len(known) > self.remembered:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        count = len(words) - self.size + 1
        mixed = np.zeros(count, np.uint64)
        for k in range(self.size):
            mixed = mixed * MIX[0] + (hashes[k : k + count] ^ MIX[1])
            mixed ^= mixed >> np.uint64(31)
        return np.unique(_mix(mixed))


def spread_bits(count: int) -> int:
    """Ranges of hashes by which sets of this size are compared, as a power of two: half an element to one element a range."""
    return max(7, count.bit_length())


def spread_of(shingles: np.ndarray) -> bytes:
    """Which ranges of hashes hold an odd number of the set's elements, a bit each; two sets differ in an element at least wherever these differ."""
    bits = spread_bits(len(shingles))
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def fold(odd: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``spread_of`` over as many ranges as fit into ``width`` bytes: what is odd in two neighbouring ranges is even in both together."""
    while odd.shape[1] > width:
        both = np.unpackbits(odd, axis=1)
        odd = np.packbits(both[:, ::2] ^ both[:, 1::2], axis=1)
    return odd


def possible_links(sizes: list[int], spreads: list[bytes], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions that neither their sizes nor their spreads keep from being linked."""
    order = sorted(range(len(sizes)), key=lambda k: len(spreads[k]))
    widths, count = [len(spreads[k]) for k in order], np.array([sizes[k] for k in order], np.int64)
    for width in dict.fromkeys(widths):
        start, end = bisect_left(widths, width), bisect_left(widths, width + 1)
        wider = [widths.index(w) for w in dict.fromkeys(widths[start:])] + [len(widths)]
        odd = np.concatenate([fold(np.frombuffer(b"".join(spreads[k] for k in order[a:b]), np.uint8).reshape(b - a, -1), width) for a, b in zip(wider, wider[1:], strict=False)])
        words = odd.view(np.uint64)
        for k in range(start, end):
            n, other = count[k], count[k + 1 :]
            near = (np.minimum(n, other) * den >= np.maximum(n, other) * num).nonzero()[0]
            differ = np.bitwise_count(words[k - start + 1 + near] ^ words[k - start]).sum(1, dtype=np.int64)
            for j in near[differ <= (other[near] + n) * (den - num) // (den + num)].tolist():
                yield order[k], order[k + 1 + j]


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


class Signatures:
    """Part signatures under the threshold ``num / den``; see the module text."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.ends, self.plans = num, den, [1], {}

    def interval(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return bisect_left(self.ends, size)

    def plan(self, interval: int) -> tuple[np.ndarray, int] | None:
        """Bounds of the parts for pairs whose larger set lies in ``interval``, and how many sparse parts may be left out."""
        if interval not in self.plans:
            while len(self.ends) <= interval:
                self.ends.append((self.ends[-1] + 1) * self.den // self.num)
            differ = 2 * self.ends[interval] * (self.den - self.num) // (self.den + self.num)
            spare = 1 + differ // 12 if differ >= 8 else 0
            parts = differ + 1 + spare
            bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
            self.plans[interval] = (bounds, spare) if differ else None
        return self.plans[interval]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        own, out = self.interval(len(shingles)), []
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles * MIX[0] ^ (shingles >> np.uint64(15)), dtype=np.uint64)])
        for interval in (own, own + 1):
            plan = self.plan(interval)
            if plan is None:
                continue
            bounds, spare = plan
            cuts = np.concatenate([[0], np.searchsorted(shingles, bounds), [len(shingles)]])
            part = np.arange(len(cuts) - 1, dtype=np.uint64) + np.uint64(interval << 32)
            signs = _mix((sums[cuts[1:]] - sums[cuts[:-1]]) * MIX[1] + part * MIX[0])
            # leaving out sparse parts is exact: equal parts are sparse in both sets, and one more part than ``spare`` is equal
            held, mean = np.diff(cuts), len(shingles) / len(part)
            sparse = held < (3 if mean >= 7 else 2 if mean >= 3.5 else 1)
            out.append(signs[~sparse] if sparse.sum() <= spare else signs)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _reference(partition: int, flush: int) -> int:
    """First reference of one flush of one task; a document adds its place in the flush, below 2^16."""
    return (partition << 24 | flush) << 16


def _pack_pairs(signs: np.ndarray, places: np.ndarray) -> bytes:
    """Seven bytes a signature: 40 bits of it (its bucket tells more) and the document's place in the flush."""
    return signs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + places.astype("<u2").tobytes()


def _unpack_pairs(packed: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    count = len(packed) // 7
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8, 5 * count).reshape(-1, 5)
    return wide.view("<u8").ravel(), np.frombuffer(packed, "<u2", count, 5 * count).astype(np.int64) + first


def documents_and_edges(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """One pass over the texts: rows (doc_id, n, node, ref) of documents and (a, star, b) of edges between refs that share a signature.

    A ``ref`` stands for the document in one task that was first to have its set; copies after it there have none. Sets of one
    node share all their signatures, so all refs of a node are in one component.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 16 * partitions

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signatures, partition = Shingler(size), Signatures(num, den), TaskContext.get().partitionId()
        rows, spreads, signs, counts, held, flushes, seen = [], [], [], [], 0, 0, set()

        def flush() -> pa.RecordBatch:
            signed = np.concatenate([*signs, np.zeros(0, np.uint64)])
            bucket = (signed % np.uint64(buckets)).astype(np.int64)
            order, ends = np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))
            rest, places = (signed // np.uint64(buckets))[order], np.repeat([c[0] for c in counts], [c[1] for c in counts]).astype(np.int64)[order]
            pairs = [_pack_pairs(*x) for x in zip(np.split(rest, ends[:-1]), np.split(places, ends[:-1]), strict=True)]
            ids = np.array(rows, ROW)
            share = np.arange(len(ids)) % buckets
            own = [x.tobytes() for x in np.split(ids[np.argsort(share, kind="stable")], np.cumsum(np.bincount(share, minlength=buckets))[:-1])]
            spread = [spreads[k::buckets] for k in range(min(buckets, len(spreads)))] + [[]] * max(0, buckets - len(spreads))
            full = [k for k in range(buckets) if own[k] or pairs[k]]
            first = pa.array([_reference(partition, flushes)] * len(full), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), first, pa.array([own[k] for k in full], pa.binary()),
                                               pa.array([spread[k] for k in full], pa.list_(pa.binary())), pa.array([pairs[k] for k in full], pa.binary())],
                                              ["bucket", "flush", "docs", "spreads", "pairs"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shingles = shingler(text)
                digest, ref = set_digest(shingles), -1
                if len(shingles) and digest not in seen:
                    if len(seen) < FLUSH:  # only saves repeated signatures of copies; they are harmless
                        seen.add(digest)
                    ref = _reference(partition, flushes) + len(rows)
                    signs.append(signatures(shingles))
                    counts.append((len(rows), len(signs[-1])))
                    held += len(signs[-1])
                rows.append((doc_id, len(shingles), digest - (1 << 63), ref))
                spreads.append(b"" if ref < 0 else spread_of(shingles))
                if held >= FLUSH or len(rows) >= 1 << 16:
                    yield flush()
                    rows, spreads, signs, counts, held, flushes = [], [], [], [], 0, flushes + 1
        if rows:
            yield flush()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for k, first, own, spreads, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own:
                    ids = np.frombuffer(own, ROW)
                    yield _rows(ids["doc"], ids["n"], ids["node"], ids["ref"], spreads, None, None, None)
                if k != bucket:
                    yield _star(held)
                    bucket, held = k, []
                held.append((packed, first))
        yield _star(held)

    packed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(emit, "bucket int, flush long, docs binary, spreads array<binary>, pairs binary")
    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(pair, "doc_id long, n long, node long, ref long, spread binary, a long, star long, b long")


def _rows(doc, n, node, ref, spread, a, star, b) -> pa.RecordBatch:
    count = len(doc) if doc is not None else len(a)
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
    columns = [pa.array(x, kind) if x is not None else pa.nulls(count, kind) for x, kind in zip((doc, n, node, ref, spread, a, star, b), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "ref", "spread", "a", "star", "b"])


def _star(held: list[tuple[bytes, int]]) -> pa.RecordBatch:
    """Edges from the smallest reference of each signature to the others that have it."""
    parts = [_unpack_pairs(*x) for x in held if x[0]]
    none = _rows(None, None, None, None, None, [], [], [])
    if not parts:
        return none
    sig, ref = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(sig, kind="stable")
    sig, ref = sig[order], ref[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    if new.all():
        return none
    hub = np.minimum.reduceat(ref, np.flatnonzero(new))[np.cumsum(new) - 1]
    # a document that comes first for many signatures has a star for every residue of them, not one for all
    edges = np.unique(np.stack([hub, (sig % np.uint64(STARS)).astype(np.int64), ref])[:, hub != ref], axis=1)
    return _rows(None, None, None, None, None, edges[0], edges[1], edges[2])


class Classes:
    """Union-find with the smallest member as the root."""

    def __init__(self, count: int) -> None:
        self.up = list(range(count))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


class InvertedLists:
    """Shingle to the ascending documents that hold it, for one chunk of sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.docs, self.bounds = of[order].tolist(), np.append(starts, len(tokens))

    def of(self, tokens: np.ndarray) -> list[list[int]]:
        at = np.searchsorted(self.tokens, tokens)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens)]
        return [self.docs[a:b] for a, b in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist(), strict=True)]


def divide_skip(lists: list[list[int]], least: int, needed, wanted) -> Iterator[int]:
    """Documents occurring in enough of ``lists``.

    ``least`` is the smallest overlap any document needs, ``needed(doc)`` the overlap of that document, ``wanted(doc)`` whether it
    is still of interest. Short lists are merged by a heap; a document found there often enough is probed in the long lists.
    """
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    longest = max(len(lists[-1]), 2)
    long_count = min(least - 1, int(least / (0.0085 * np.log2(longest) + 1)))
    short, long = lists[: len(lists) - long_count], lists[len(lists) - long_count :]
    at_least, current, count = least - long_count, -1, 0

    def reaches(doc: int, found: int) -> bool:
        need = needed(doc)
        for k, own in enumerate(long):
            if found >= need or found + len(long) - k < need:
                break
            i = bisect_left(own, doc)
            found += i < len(own) and own[i] == doc
        return found >= need

    for doc in heapq.merge(*short):
        if doc == current:
            count += 1
            continue
        if count >= at_least and wanted(current) and reaches(current, count):
            yield current
        current, count = doc, 1
    if count >= at_least and wanted(current) and reaches(current, count):
        yield current


def overlap_needed(a: int, b: int, num: int, den: int) -> int:
    """Smallest intersection of sets of these sizes with ``den * intersection >= num * union``."""
    return -(-num * (a + b) // (num + den))


def link_block(sets: list[np.ndarray], num: int, den: int, classes: Classes | None = None, queries: list[int] | None = None) -> Classes:
    """Join linked sets of one chunk; ``queries`` (default all) are searched for, against all sets.

    In a chunk of more than 64 sets most are usually copies of one text: a first comparison with one set forms the large class,
    and only sets outside it, against which every link between classes has an end, have to be searched for.
    """
    classes = classes or Classes(len(sets))
    sizes = [len(s) for s in sets]

    def wanted_from(q: int):
        low, high, own = -(-num * sizes[q] // den), sizes[q] * den // num, classes.find(q)
        return lambda doc: low <= sizes[doc] <= high and classes.find(doc) != own and classes.find(doc) != classes.find(q)

    if queries is None:
        queries = list(range(len(sets)))
        if len(sets) > 64:
            hub = int(np.argsort(sizes)[len(sizes) // 2])
            for k in queries:
                both = overlap_needed(sizes[hub], sizes[k], num, den)
                if k != hub and both <= min(sizes[hub], sizes[k]) and len(np.intersect1d(sets[hub], sets[k], assume_unique=True)) >= both:
                    classes.join(hub, k)
            roots = [classes.find(k) for k in queries]
            largest = max(set(roots), key=roots.count)
            queries = [k for k in queries if roots[k] != largest]
    if not queries:
        return classes
    index = InvertedLists(sets)
    for q in queries:
        least = -(-num * sizes[q] // den)
        found = divide_skip(index.of(sets[q]), least, lambda doc, q=q: overlap_needed(sizes[q], sizes[doc], num, den), wanted_from(q))
        for doc in found:
            classes.join(q, doc)
    return classes


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows with equal first ``keys`` columns, from rows sorted by them."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(list(row.values())[:keys])
            if own != key:
                if held:
                    yield key, held
                key, held = own, []
            held.append(row)
    if held:
        yield key, held


def _by_block(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Deal rows out by block, sort, and run over one block after the other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, schema)


def candidate_edges(edges: DataFrame, rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b) edges that keep together what can be linked in each star; stars of more than ``block`` documents stay whole."""
    stars = edges.distinct()
    hubs = stars.select(F.col("a").alias("hub"), "star", F.col("a").alias("ref")).distinct()
    both = stars.select(F.col("a").alias("hub"), "star", F.col("b").alias("ref")).unionByName(hubs)
    members = both.join(rows.select("ref", "n", "spread"), "ref").select("hub", "star", "ref", "n", "spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        hub, held, whole = None, [], False

        def compare() -> None:
            if not held:
                return
            classes = Classes(len(held))
            for k, other in possible_links([h[1] for h in held], [h[2] for h in held], num, den):
                classes.join(k, other)
            out.extend((held[classes.find(k)][0], held[k][0]) for k in range(len(held)) if classes.find(k) != k)

        for batch in batches:
            for own, star, ref, n, spread in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (own, star) != hub:
                    compare()
                    hub, held, whole = (own, star), [], False
                if whole:
                    out.append((own, ref))
                    continue
                held.append((ref, n, spread))
                if len(held) > block:
                    out.extend((own, h[0]) for h in held)
                    held, whole = [], True
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])
            out = []
        compare()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    dealt = members.repartition("hub", "star").sortWithinPartitions("hub", "star", "ref")
    return cut(dealt.mapInArrow(run, "a long, b long"))


def shingle_sets(reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``reps`` (first, node, ...) with the shingle set of the node, from the text of the document ``first``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            sets = [shingler(t) for t in batch.column("text").to_pylist()]
            same = [set_digest(s) - (1 << 63) == node for s, node in zip(sets, batch.column("node").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("comp"), batch.column("chunk"), batch.column("chunks"), batch.column("node"),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["comp", "chunk", "chunks", "node", "members"])
            yield out.filter(pa.array(same))

    texts = docs.select(F.col("doc_id").alias("first"), "text").join(hinted(reps.select("first").distinct()), "first", "left_semi")
    joined = texts.join(reps, "first")
    sets = joined.select("comp", "chunk", "chunks", "node", "text").mapInArrow(build, "comp long, chunk int, chunks int, node long, members binary")
    return sets


def _local_roots(num: int, den: int, keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _blocks(batches, keys):
            rows = list({r["node"]: r for r in rows}.values())
            classes = link_block([np.frombuffer(r["members"], np.uint64) for r in rows], num, den)
            for k, r in enumerate(rows):
                root = rows[classes.find(k)]["node"]
                if root != r["node"]:
                    out.append((r["comp"], r["node"], root))
            if len(out) >= 4096:
                yield _triples(out, names)
                out = []
        yield _triples(out, names)

    return run


def _triples(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names)


def node_links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, edges: DataFrame, size: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(a, b) links between nodes that connect all that is linked; ``rows`` is (ref, node, n, spread), ``nodes`` is (node, first), ``edges`` joins refs."""
    near = candidate_edges(edges, rows, num, den, 64 * block)
    labels = connected_components(near).select(F.col("node").alias("ref"), F.col("component").alias("comp"))
    coarse = cut(labels.join(rows.select("ref", "node"), "ref").groupBy("node").agg(F.min("comp").alias("comp")))
    counts = coarse.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    reps = coarse.join(nodes, "node").join(counts, "comp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    sets = cut(shingle_sets(cut(reps.select("comp", "chunk", "chunks", "node", "first")), docs, size))
    names, schema = ["comp", "node", "root"], "comp long, node long, root long"
    columns = ["comp", "chunk", "node", "members"]
    first = cut(_by_block(sets.select(*columns), ["comp", "chunk"], _local_roots(num, den, 2, names), schema))
    links = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    wide = sets.where("chunks > 1")
    if wide.isEmpty():
        return links
    # large blocks: link the representatives of the chunks' classes, in one chunk as long as they are few
    roots = wide.join(first.select("node", "root"), "node", "left_anti")
    per = roots.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    roots = roots.join(per, "comp").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    second = cut(_by_block(roots.select(*columns), ["comp", "chunk"], _local_roots(num, den, 2, names), schema))
    links = links.unionByName(second.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return links.unionByName(_across_chunks(wide, links, num, den, block))


def _across_chunks(wide: DataFrame, links: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """The links that are still missing in blocks of several chunks: whatever lies outside the largest class asks every chunk."""
    labels = connected_components(links)
    known = cut(wide.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    size = known.groupBy("comp", "label").agg(F.count("*").alias("members_n"))
    main = size.groupBy("comp").agg(F.max(F.struct("members_n", "label")).getField("label").alias("main"))
    asking = known.join(main, "comp").where("label <> main")
    parts = asking.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asking = asking.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    asked = known.join(parts, "comp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["comp", "chunk", "part", "node", "label", "members"]
    both = asked.select(*columns, F.lit(0).alias("asks")).unionByName(asking.select(*columns, F.lit(1).alias("asks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches, 3):
            rows = list({(r["node"]): r for r in sorted(rows, key=lambda r: r["asks"])}.values())
            first: dict[int, int] = {}
            classes = Classes(len(rows))
            for k, r in enumerate(rows):
                classes.join(first.setdefault(r["label"], k), k)
            before = [classes.find(k) for k in range(len(rows))]
            queries = [k for k, r in enumerate(rows) if r["asks"]]
            link_block([np.frombuffer(r["members"], np.uint64) for r in rows], num, den, classes, queries)
            out = {(rows[0]["comp"], rows[k]["label"], rows[classes.find(k)]["label"]) for k in set(before)}
            yield _triples([x for x in out if x[1] != x[2]], ["comp", "node", "root"])

    found = _by_block(both, ["comp", "chunk", "part"], run, "comp long, node long, root long")
    return found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: sets link when ``den * intersection >= num * union``."""
    passed = cut(documents_and_edges(docs, size, num, den))
    rows = passed.where("doc_id is not null").select("doc_id", "n", "node", "ref", "spread")
    nodes = cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")))
    links = node_links(docs, rows.where("ref >= 0"), nodes, passed.where("a is not null").select("a", "star", "b"), size, num, den, block)
    labels = cut(connected_components(links))
    smallest = nodes.join(labels, "node").groupBy("component").agg(F.min("first").alias("smallest"))
    linked = labels.join(smallest, "component").select("node", "smallest")
    found = cut(nodes.join(linked, "node", "left").select("node", F.coalesce("smallest", "first").alias("component_id")))
    ids = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    known = rows.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), ids.alias("component_id"))
    lost = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(lost)


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without those that are linked, directly or over others, with a document of a smaller id."""
    gone = cut(components(docs, size, num, den).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(hinted(gone), "doc_id", "left_anti").select(*docs.columns)
