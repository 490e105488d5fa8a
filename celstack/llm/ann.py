"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Index. Equal vectors are one class. Centroids, a random rotation and the number of lists to probe are fitted on a bounded sample
(``sample`` vectors by hash); every class is then assigned to the list of its nearest centroid. Lists are cut into chunks of at
most ``chunk`` vectors on average, and each chunk stores its rotated vectors in blocks of ``block`` dimensions.

Search. A query probes its lists in two steps: the nearest few give a first bound for its k-th best, the others are scanned with
that bound. A scan adds up squared distances one block of dimensions at a time. Under a random rotation the partial distance
over d of D dimensions, times D / d, estimates the whole; a candidate is abandoned once the estimate exceeds its limit by
(1 + epsilon / sqrt(d)) in distance, a hypothesis test against the distance that an inner product equal to the bound would have.
Survivors are scored exactly in double precision on the original vectors.

Skew: a third of all rows may be copies of one vector (one class with its k + 1 smallest ids) or fall into one list (chunks), and a
list may be asked by any number of queries (parts). Nothing but the fitted model passes through the driver.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
than most (ties: the shorter); null ids take no part; rows of one id exclude each other; ties go to the smaller id. Columns
other than ``vec_id`` and ``embedding`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import hashed_sample

SHARES = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")
    sizes = good.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return good.where(F.size("embedding") == sizes[0]["dims"]) if sizes else good


def vector_classes(good: DataFrame, keep: int) -> DataFrame:
    """(rep, embedding, members): distinct vectors with their ``keep`` smallest ids; the smallest names the class."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = good.distinct().withColumn("rank", rank).where(F.col("rank") <= keep)
    return first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("rep"), "embedding", "members")


@dataclass
class Model:
    """Rotation, centroids of the rotated space, and how many lists a query probes."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors.astype(np.float64) @ self.rotation).astype(np.float32)

    def nearest_list(self, rotated: np.ndarray) -> np.ndarray:
        return np.argmin(np.square(self.centroids).sum(1) - 2 * rotated @ self.centroids.T, axis=1)

    def probed(self, rotated: np.ndarray) -> np.ndarray:
        return np.argsort(-(rotated @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]


def fit(classes: DataFrame, count: int, k: int, target: float = 0.96, sample: int = 16384, most_lists: int = 4096, seed: int = 11) -> Model | None:
    """Fit on ``sample`` classes; the probes reach ``target`` recall among them, and more among all, where neighbours are nearer."""
    rows = hashed_sample(classes.select("rep", "embedding"), "rep", count, sample).collect()
    if not rows:
        return None
    vectors = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["rep"])], np.float32)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(vectors.shape[1],) * 2))[0]
    points = (vectors.astype(np.float64) @ rotation).astype(np.float32)
    lists = max(1, min(most_lists, round(count**0.5), len(points)))
    centroids = points[rng.permutation(len(points))[:lists]].copy()
    model = Model(rotation, centroids, lists)
    for _ in range(8):
        own = model.nearest_list(points)
        sizes = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, points[:, d], lists) for d in range(points.shape[1])], axis=1)
        centroids[sizes > 0] = (sums[sizes > 0] / sizes[sizes > 0, None]).astype(np.float32)
    own, asked = model.nearest_list(points), points[rng.permutation(len(points))[:256]]
    products = asked @ points.T
    top = np.argpartition(-products, min(k, len(points) - 1), axis=1)[:, : k + 1]
    order = model.probed(asked)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    at = np.take_along_axis(place, own[top], axis=1)
    model.probes = next(n for n in (int(np.ceil(s * lists)) for s in SHARES) if (at < n).mean() >= target or n >= lists)
    return model


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def build_index(classes: DataFrame, model: Model, chunk: int) -> DataFrame:
    """(list, chunk, rep, vector, rotated): every class in its list; vectors as binary float32."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("embedding"))
            rotated = model.rotate(vectors)
            yield pa.RecordBatch.from_arrays([pa.array(model.nearest_list(rotated), pa.int32()), batch.column("rep"), pa.array([v.tobytes() for v in vectors], pa.binary()),
                                              pa.array([v.tobytes() for v in rotated], pa.binary())], ["list", "rep", "vector", "rotated"])

    index = cut(classes.select("rep", "embedding").mapInArrow(assign, "list int, rep long, vector binary, rotated binary"))
    chunks = index.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    return cut(index.join(chunks, "list").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")))


def probe_rows(queries: DataFrame, model: Model, first: int, last: int) -> DataFrame:
    """(rep, vector, bound, list): one row per query and probed list number ``first`` to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = model.probed(model.rotate(_matrix(batch.column("vector"), len(model.rotation))))[:, first:last]
            at = np.repeat(np.arange(len(lists)), lists.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("rep", "vector", "bound")), pa.array(lists.ravel(), pa.int32())],
                                             ["rep", "vector", "bound", "list"])

    return queries.select("rep", "vector", "bound").mapInArrow(run, "rep long, vector binary, bound double, list int")


def scan_block(queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, rotation: np.ndarray, k: int,
               block: int, epsilon: float) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, score) of what the adaptive scan of one chunk leaves in each query's best ``k``, by exact score."""
    dims = rotated.shape[1]
    turned = (queries.astype(np.float64) @ rotation).astype(np.float32)
    norms = np.square(queries, dtype=np.float64).sum(1)[:, None] + np.square(vectors, dtype=np.float64).sum(1)[None, :]
    limit = norms - 2 * bounds[:, None]  # squared distance at an inner product equal to the bound
    alive, partial = np.ones(limit.shape, bool), np.zeros(limit.shape, np.float32)
    for start in range(0, dims, block):
        stop = min(start + block, dims)
        a, b = turned[:, start:stop], rotated[:, start:stop]
        if alive.mean() > 0.2:
            partial += np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * (a @ b.T)
        else:
            q, c = np.nonzero(alive)
            partial[q, c] += np.square(a[q] - b[c]).sum(1)
        slack = 1 + epsilon / np.sqrt(stop) if stop < dims else 1 + 1e-4
        alive &= partial * (dims / stop) <= slack * slack * limit + 1e-6
        if not alive.any():
            return
    for q in np.flatnonzero(alive.any(axis=1)):
        left = np.flatnonzero(alive[q])
        scores = (vectors[left].astype(np.float64) * queries[q].astype(np.float64)).sum(axis=1)
        if len(left) > k:
            best = np.partition(scores, len(left) - k)[len(left) - k]
            left, scores = left[scores >= best], scores[scores >= best]
        for c, score in zip(left.tolist(), scores.tolist(), strict=True):
            yield int(q), c, score


def scan(index: DataFrame, probes: DataFrame, model: Model, k: int, block: int, epsilon: float, together: int = 1024) -> DataFrame:
    """(query, rep, score): every probed chunk scanned for its queries."""
    parts = probes.groupBy("list").agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    asked = probes.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    chunks = index.select("list", "chunks").distinct()
    asked = asked.join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    stored = index.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["list", "chunk", "part", "kind", "rep", "vector", "rotated", "bound"]
    both = stored.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)}).select(*columns).unionByName(
        asked.withColumns({"kind": F.lit(1), "rotated": F.lit(b"")}).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, held, key = len(model.rotation), [], None

        def found() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
            out: list[tuple] = []
            if rows is not None:
                kind = rows.column("kind").to_numpy(zero_copy_only=False)
                split = int((kind == 0).sum())
                if 0 < split < len(kind):
                    reps, vectors = rows.column("rep").to_numpy(zero_copy_only=False), _matrix(rows.column("vector"), dims)
                    bounds = rows.column("bound").to_numpy(zero_copy_only=False)[split:]
                    rotated = _matrix(rows.column("rotated").slice(0, split), dims)
                    out = [(reps[split + q], reps[c], s) for q, c, s in
                           scan_block(vectors[split:], bounds, vectors[:split], rotated, model.rotation, k, block, epsilon)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "rep", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "chunk", "part")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = tuple(keys[:, a].tolist())
                if own != key:
                    yield found()
                    held, key = [], own
                held.append(batch.slice(a, b - a))
        yield found()

    dealt = both.repartition("list", "chunk", "part").sortWithinPartitions("list", "chunk", "part", "kind")
    return dealt.mapInArrow(run, "query long, rep long, score double")


def best_of(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best candidates of each query, ties to the smaller class."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def search(vectors: DataFrame, is_query, k: int = 20, block: int = 16, epsilon: float = 2.1, chunk: int = 4096, first_lists: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for every row with ``is_query``."""
    good = cut(usable(vectors))
    classes = cut(vector_classes(good, k + 1))
    model = fit(classes, classes.count(), k)
    if model is None:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = build_index(classes, model, chunk)
    asking = good.where(is_query).join(classes.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    asking = cut(asking)
    queries = index.select("rep", "vector").join(asking.select("rep").distinct(), "rep")
    # a class holds up to k + 1 ids, so k + 1 classes always hold k candidates besides the query's own id
    near = cut(scan(index, probe_rows(queries.withColumn("bound", F.lit(-1e30)), model, 0, first_lists), model, k + 1, block, epsilon))
    bounds = best_of(near, k + 1).groupBy(F.col("query").alias("rep")).agg(
        F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(-1e30)).alias("bound"))
    bounded = queries.join(bounds, "rep")
    far = scan(index, probe_rows(bounded, model, first_lists, model.probes), model, k + 1, block, epsilon)
    found = cut(best_of(near.unionByName(far), k + 1))
    named = found.join(classes.select("rep", "members"), "rep").select("query", "score", F.explode("members").alias("vec_id"))
    # at most (k + 1) ids of each of k + 1 classes; the k + 1 best of them serve every row of the query's class
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = cut(ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best")))
    own = asking.join(lists, asking["rep"] == lists["query"]).select("query_id", F.filter("best", lambda x: x["vec_id"] != F.col("query_id")).alias("best"))
    out = own.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
