"""Near-duplicate families of texts and of rasters: an index, exact verification of what meets in it, connected components.

Equal shingle sets are one node before anything is compared. A node has ``BANDS`` band keys of ``ROWS`` minima each; nodes with a key in
common meet in a bucket. In a bucket every node is first held against one hub, chosen by a hash so that it differs from bucket to bucket.
These links join most of a group of copies. What is left to try are pairs of different families in one bucket: the nodes of all but the
bucket's largest family against the others, so a group of thousands of copies is never expanded into its pairs.

Buckets in which more than ``HOT`` nodes would ask (a passage that many texts share) are split by a second band, and again by a third:
texts that are similar enough agree on about two fifths of all bands, texts with only a passage in common do not. Pairs whose sets
differ too much in size, or whose signatures agree on fewer than half of their minima, are not verified; verification compares the sets of shingles themselves.

At a similarity of 0.8 a pair misses all bands, or is refused by its signatures, with a probability under 1e-6; every reported link is exact.

Rasters have a hash of 64 gradient bits, of the means of 9 x 8 blocks, in four words of 16 bits. Two hashes that differ in at most three bits
agree on one word, so the words are the buckets; a bucket with too many askers is split by another word and its one-bit neighbours, which
keeps every pair in reach. Verification is the correlation of the block means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import connected_components

BANDS, ROWS, HOT, SPLITS = 32, 4, 64, 2
SIGNATURE = BANDS * ROWS
AGREEING = SIGNATURE // 2
SPACES = bytes([9, 10, 11, 12, 13, 32])
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SPACES else b for b in range(256))
REMEMBERED = 1 << 18
AT_ONCE = 2048
MOST_BROADCAST = 1 << 20  # ids: 8 MB


def words(blob: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (blob or b"").translate(LOWER).split()


def shingles(blob: bytes | None, size: int) -> set[bytes]:
    """Distinct runs of ``size`` words; of fewer words the whole sequence; none of no words."""
    w = words(blob)
    if len(w) < size:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = value
        return value


def shingle_hashes(words_of: list[bytes], size: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    values = np.fromiter(map(known.__getitem__, words_of), np.uint64, len(words_of))
    size = min(size, len(values))
    if not size:
        return values
    mixed = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + values[k : k + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of the hashes' upper 32 bits under each of the linear maps, which are one-to-one as their factors are odd."""
    low, upper = np.full(len(factors), 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(upper), AT_ONCE):
        part = factors[:, None] * upper[start : start + AT_ONCE]
        part += offsets[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def signatures(texts: DataFrame, size: int) -> DataFrame:
    """(item_id, n, digest, sig) of texts that have shingles, by (item_id, text)."""
    names = ["item_id", "n", "digest", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(2024)
        factors = rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
        offsets = rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)
        known = _Hashes()
        for batch in batches:
            rows = []
            for item, blob in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                hashes = shingle_hashes(words(blob), size, known)
                if len(hashes):
                    rows.append((item, len(hashes), xxhash.xxh3_128_hexdigest(hashes.tobytes()), signature(hashes, factors, offsets).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    known = texts.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return known.mapInArrow(run, "item_id long, n long, digest string, sig binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(node, keys): the band keys of ``nodes`` (node, sig)."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    return nodes.select("node", keys.alias("keys"))


def buckets(keyed: DataFrame) -> DataFrame:
    """(bucket, band, node) of all buckets with at least two nodes."""
    placed = keyed.select("node", F.posexplode("keys").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    return cut(placed.join(shared, "bucket").select("bucket", "band", "node"))


def split_by_next_band(placed: DataFrame) -> DataFrame:
    """Buckets divided by every later band of their nodes: two nodes stay together for each further band they share."""
    further = placed.select("node", "bucket", "band", F.posexplode("keys").alias("next", "key")).where("next > band")
    return further.select(F.xxhash64("bucket", "key").alias("bucket"), F.col("next").alias("band"), "node")


def across_families(met: DataFrame, keyed: DataFrame, families: DataFrame, divide: Callable[[DataFrame], DataFrame], splits: int) -> DataFrame:
    """Pairs (a, b) of nodes of different families that share a bucket; nodes of a bucket's largest family do not ask.

    A bucket in which more than ``HOT`` nodes would ask is divided by the ``keyed`` (node, keys) of its nodes first, up to ``splits`` times.
    """
    found, placed = [], met
    for split in range(splits + 1):
        placed = placed.join(families, "node")
        shares = placed.groupBy("bucket", "family").agg(F.count("*").alias("n"))
        largest = shares.groupBy("bucket").agg(F.max_by("family", F.struct("n", "family")).alias("top"), (F.sum("n") - F.max("n")).alias("asking")).where("asking > 0")
        mixed = cut(placed.join(largest, "bucket"))
        ready = mixed if split == splits else mixed.where(F.col("asking") <= HOT)
        asking = ready.where("family <> top").select("bucket", F.col("node").alias("x"), F.col("family").alias("fx"))
        crossed = ready.join(asking, "bucket").where("fx <> family and (family = top or x < node)")
        found.append(cut(crossed.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()))
        if split < splits:
            placed = divide(mixed.where(F.col("asking") > HOT).select(*met.columns).join(keyed, "node"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _agreeing(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets large enough for each other whose signatures agree on at least half of their minima.

    An intersection is at most the smaller set and a union at least the larger one, so no link is lost by the sizes.
    """
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
                yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([batch.column(c) for c in names], names).filter(pa.array((left == right).sum(axis=1) >= AGREEING)))

    with_a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b").where(
        F.lit(den) * F.least("n_a", "n_b") >= F.lit(num) * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ids whose sets of shingles have ``den`` * intersection >= ``num`` * union."""
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            ids = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            keep, last = [], {}
            for (i, j), a, b in zip(ids, left, right, strict=True):
                x, y = (last.get(k) or shingles(text, size) for k, text in ((i, a), (j, b)))
                last = {i: x, j: y}  # rows with one document are often side by side
                both = len(x & y)
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([batch.column(c) for c in names], names).filter(pa.array(keep, pa.bool_())))

    pairs = cut(pairs)
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("item_id")).distinct())
    texts = texts.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "item_id", "left_semi")  # before anything is shuffled
    with_a = pairs.join(texts.select(F.col("item_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("item_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def grow(nodes: DataFrame, met: DataFrame, keyed: DataFrame, verify: Callable[[DataFrame], DataFrame], divide: Callable[[DataFrame], DataFrame], splits: int) -> DataFrame:
    """(node, family) of all ``nodes``: hubs first, then what is left across families. ``met`` is (bucket, node, ...)."""
    hub = F.min_by("node", F.xxhash64("bucket", "node")).alias("hub")
    stars = met.join(met.groupBy("bucket").agg(hub), "bucket").where("hub <> node")
    tried = cut(stars.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    links = cut(verify(tried))
    pairs = across_families(met, keyed, _families(nodes, links), divide, splits).join(tried, ["a", "b"], "left_anti")
    return _families(nodes, links.unionByName(cut(verify(pairs))))


def _families(nodes: DataFrame, links: DataFrame) -> DataFrame:
    labels = connected_components(links).select("node", F.col("component").alias("family"))
    return cut(nodes.select("node").join(labels, "node", "left").withColumn("family", F.coalesce("family", "node")))


def near_duplicate_families(texts: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(item_id, n_shingles, family, members) of every item of ``texts`` (item_id, text).

    Items are linked when ``den`` times the intersection of their sets of ``size``-word shingles is at least ``num`` times the union;
    a family is what links reach, named by its smallest id. A null, empty or blank text has no shingles and is a family of its own.
    Rows with the same id are one item, judged by its smallest text; rows without an id are left out; other columns are not read.
    """
    texts = texts.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    repeated = cut(texts.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id"))
    if not repeated.isEmpty():  # only then are texts shuffled, those of repeated ids
        once = repeated.count() <= MOST_BROADCAST
        side = F.broadcast(repeated) if once else repeated
        smallest = texts.join(side, "item_id", "left_semi").groupBy("item_id").agg(F.min("text").alias("text"))
        texts = cut(texts.join(side, "item_id", "left_anti").unionByName(smallest))
    marked = cut(signatures(texts, size))
    classes = marked.groupBy("digest").agg(F.min("item_id").alias("node"))
    nodes = cut(marked.join(classes, F.col("node") == F.col("item_id")).select("node", "n", "sig"))
    keyed = cut(band_keys(nodes))
    families = grow(nodes, buckets(keyed), keyed, lambda pairs: _linked(_agreeing(pairs, nodes, num, den), texts, size, num, den), split_by_next_band, SPLITS)
    member = marked.join(classes, "digest").join(families, "node").select("item_id", F.col("n").alias("n_shingles"), "family")
    placed = texts.select("item_id").join(member, "item_id", "left").select(
        "item_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce("family", "item_id").alias("family"))
    placed = cut(placed)
    return placed.join(placed.groupBy("family").agg(F.count("*").alias("members")), "family").select("item_id", "n_shingles", "family", "members")


ACROSS, DOWN = 9, 8
RADIUS = 3


def raster_nodes(rasters: DataFrame, pixels: DataFrame) -> DataFrame:
    """(raster_id, width, height, digest, thumb, words) of rasters (raster_id, width, height) with pixels (raster_id, x, y, r, g, b, a).

    ``thumb`` holds the 72 block means of luminance in sixteenths, row by row, and ``words`` the four words of gradient bits; both are null
    where a block has no pixel. ``digest`` is the same for equal rasters whatever the order of their pixels.
    """
    luma = F.expr("(2126 * r + 7152 * g + 722 * b) div 10000")
    placed = pixels.join(rasters, "raster_id").withColumn("block", F.expr(f"(y * {DOWN} div height) * {ACROSS} + x * {ACROSS} div width"))
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "x", "y", "r", "g", "b", "a")).alias(f"mark{k}") for k in (1, 2)]
    blocks = placed.groupBy("raster_id", "width", "height", "block").agg(F.sum(luma).alias("s"), F.count("*").alias("n"), *mark)
    whole = blocks.groupBy("raster_id", "width", "height").agg(
        F.array_sort(F.collect_list(F.struct("block", F.expr("s * 16 div n").alias("mean")))).alias("blocks"),
        F.bit_xor("mark1").alias("mark1"), F.bit_xor("mark2").alias("mark2"), F.sum("n").alias("n"))
    thumb = F.when(F.size("blocks") == ACROSS * DOWN, F.transform("blocks", lambda b: b["mean"]))
    bit = "if(thumb[(2 * k + i div 8) * 9 + i % 8] < thumb[(2 * k + i div 8) * 9 + i % 8 + 1], shiftleft(1, i), 0)"
    words = F.expr(f"if(thumb is null, null, transform(sequence(0, 3), k -> aggregate(sequence(0, 15), 0, (w, i) -> w + {bit})))")
    return whole.withColumn("thumb", thumb).select(
        "raster_id", "width", "height", F.struct("width", "height", "n", "mark1", "mark2").alias("digest"), "thumb", words.alias("words"))


def _similar_rasters(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) within the radius whose block means correlate by at least ``least``."""
    near = " + ".join(f"bit_count(words_a[{k}] ^ words_b[{k}])" for k in range(4))
    total = lambda x: f"aggregate({x}, 0L, (s, v) -> s + v)"
    product = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> u * v), 0L, (s, v) -> s + v)"
    spread = lambda x, y: f"cast({ACROSS * DOWN} * {product(x, y)} - {total(x)} * {total(y)} as double)"
    both = pairs
    for side in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(side), F.col("thumb").alias(f"thumb_{side}"), F.col("words").alias(f"words_{side}")), side)
    close = both.where(f"{near} <= {RADIUS}").selectExpr(
        "a", "b", f"{spread('thumb_a', 'thumb_b')} as cov", f"{spread('thumb_a', 'thumb_a')} as va", f"{spread('thumb_b', 'thumb_b')} as vb")
    return close.where(f"(cov > 0 and cov * cov >= {least * least}D * (va * vb)) or (va = 0 and vb = 0)").select("a", "b")


def split_by_other_word(placed: DataFrame) -> DataFrame:
    """Buckets divided by every other word and its one-bit neighbours: of three differing bits in three words, some word has at most one."""
    other = placed.select("node", "bucket", "band", F.posexplode("keys").alias("other", "word")).where("other <> band")
    probes = other.select("node", "bucket", "band", "other", F.explode(F.expr("concat(array(word), transform(sequence(0, 15), i -> word ^ shiftleft(1, i)))")).alias("probe"))
    return probes.select(F.xxhash64("bucket", "other", "probe").alias("bucket"), "band", "node")


def raster_families(rasters: DataFrame, pixels: DataFrame, least: float = 0.95) -> DataFrame:
    """(raster_id, family, members, kind) of rasters whose 64 gradient bits differ in at most three and whose block means correlate.

    ``kind`` compares a raster with the smallest id of its family: ``first`` itself, ``copy`` with the same pixels, ``recoloured`` with the
    same size and other pixels, ``resized`` with another size. Cropped rasters have other blocks and so another family. A raster with an
    empty block (sparse, or smaller than 9 x 8) is only linked to equal ones; one without pixels is a family of its own. Rows without an id
    or with a side of zero are left out.
    """
    known = rasters.where("raster_id is not null and width > 0 and height > 0").select("raster_id", "width", "height")
    found = cut(raster_nodes(known, pixels.select("raster_id", "x", "y", "r", "g", "b", "a")))
    classes = found.groupBy("digest").agg(F.min("raster_id").alias("node"))
    nodes = cut(found.join(classes, F.col("node") == F.col("raster_id")).select("node", "thumb", "words"))
    keyed = nodes.where("words is not null").select("node", F.col("words").alias("keys"))
    met = cut(keyed.select("node", F.posexplode("keys").alias("band", "word")).select(F.xxhash64("band", "word").alias("bucket"), "band", "node"))
    families = grow(nodes, met, keyed, lambda pairs: _similar_rasters(pairs, nodes, least), split_by_other_word, 1)
    placed = cut(found.join(classes, "digest").join(families, "node").select("raster_id", "digest", "family"))
    first = placed.groupBy("family").agg(F.min_by("digest", "raster_id").alias("head"), F.count("*").alias("members"))
    kind = F.expr("""case when raster_id = family then 'first' when digest = head then 'copy'
                          when digest.width = head.width and digest.height = head.height then 'recoloured' else 'resized' end""")
    judged = placed.join(first, "family").select("raster_id", "family", "members", kind.alias("kind"))
    alone = known.join(placed, "raster_id", "left_anti").select("raster_id", F.col("raster_id").alias("family"), F.lit(1).cast("bigint").alias("members"), F.lit("first").alias("kind"))
    return judged.unionByName(alone)
