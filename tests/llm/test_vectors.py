"""Nearest neighbours and image copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from celstack.llm import ann, media

SF = "/root/testdata/sf0.01"


def nearest(rows, asks, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and i is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if asks(q):
            scores = sorted((-float((v * w).sum()), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<float>, score double, `rank` int").repartition(3)


def test_odd_vectors_and_ties(vectors):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(30)]  # one vector many times: ties to the smaller id
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (None, [1.0] * 4)]
    got = {}
    for r in ann.search(vectors(rows), F.col("vec_id") % 5 == 0, k=6, chunk=7, first_lists=1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = nearest(rows, lambda q: q % 5 == 0, 6)
    assert set(got) == set(wanted)
    hits = 0
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, 7)) and q not in [v for _, v, _ in own]
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for v, _ in wanted[q]})
    assert hits >= 0.9 * 6 * len(wanted)
    assert got[100] == [(k + 1, v, s) for k, (v, s) in enumerate(wanted[100])]


def test_fewer_candidates_than_asked_and_none(vectors):
    got = ann.search(vectors([(0, [1.0, 0.0]), (5, [1.0, 1.0]), (7, [0.0, 1.0])]), F.col("vec_id") % 5 == 0, k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 5), (0, 2, 7), (5, 1, 0), (5, 2, 7)]
    assert ann.search(vectors([]), F.lit(True)).count() == 0 and ann.search(vectors([(1, None)]), F.lit(True)).count() == 0


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found = ann.search(table, F.col("vec_id") % 20 == 0, k=20).collect()
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = points @ points[at]
        scores[at] = -np.inf
        hits += len({r["vec_id"] for r in found if r["query_id"] == ids[at]} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert len(found) == 20 * (ids % 20 == 0).sum() and hits / len(found) >= 0.9


def test_scan_without_tests_is_exact():
    rng = np.random.default_rng(1)
    vectors, queries, rotation = rng.normal(size=(200, 8)).astype(np.float32), rng.normal(size=(5, 8)).astype(np.float32), np.linalg.qr(rng.normal(size=(8, 8)))[0]
    products = queries.astype(np.float64) @ vectors.T.astype(np.float64)
    bounds = np.sort(products, axis=1)[:, -10]
    found = list(ann.scan_block(queries, bounds - 1e-9, vectors, (vectors @ rotation).astype(np.float32), rotation, 10, 2, 1e6))
    assert {(q, c) for q, c, _ in found} == {(q, c) for q in range(5) for c in np.argsort(-products[q])[:10]}


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(6)
    out = []
    for n in range(12):
        big = np.clip(media._shrunk(rng.normal(0, 0.125, (16, 16)).astype(np.float32), 1 / 6) * 360 + 128, 0, 255)
        crop = np.rot90(big[3:83, 9:89], n % 4) * 0.8 + 20
        noisy = np.clip(big + rng.normal(0, 1.5, big.shape), 0, 255)
        out += [(10 * n + k, np.rint(x).astype(np.uint8)) for k, x in enumerate((big, crop, noisy, big))]
    rows = [(i, x.shape[1], x.shape[0], x.tobytes(), 1, 2, "g") for i, x in out]
    rows += [(500, 3, 3, b"abc", 1, 2, "g"), (501, None, None, None, 1, 2, "g"), (502, 0, 0, b"", 1, 2, "g"), (503, 60, 60, bytes(3600), 1, 2, "g"), (504, 60, 60, bytes(3600), 1, 2, "g"),
             (None, 3, 3, b"abcabcabc", 1, 2, "g")]
    return spark.createDataFrame(rows, "media_id long, width int, height int, pixels binary, media long, n_keypoints long, `class` string").repartition(3)


@pytest.mark.parametrize("star", [1, 16])
def test_edited_copies_meet_and_others_do_not(images, star):
    got = {r["media_id"]: r["group_id"] for r in media.copy_groups(images, star=star).collect()}
    assert len(got) == 12 * 4 + 6
    assert all(got[10 * n + k] == 10 * n for n in range(12) for k in range(4))
    assert [got[i] for i in (500, 501, 502, 503, 504, None)] == [500, 501, 502, 503, 504, None]
    assert media.copy_groups(images.limit(0)).count() == 0


def test_descriptors_turn_with_the_image():
    rng = np.random.default_rng(2)
    big = np.rint(np.clip(media._shrunk(rng.normal(0, 0.125, (16, 16)).astype(np.float32), 1 / 6) * 360 + 128, 0, 255)).astype(np.uint8)
    turned = np.ascontiguousarray(np.rot90(big))
    a, b = media.features(96, 96, big.tobytes()), media.features(96, 96, turned.tobytes())
    assert media.consensus(a, b) > 0.8 * min(len(a), len(b))
    other = np.rint(np.clip(media._shrunk(rng.normal(0, 0.125, (16, 16)).astype(np.float32), 1 / 6) * 360 + 128, 0, 255)).astype(np.uint8)
    assert media.consensus(a, media.features(96, 96, other.tobytes())) < 8


def turned_and_sized(image, degrees, scale):
    """``image`` turned about its centre and resized, between its pixels; the corners of the canvas repeat its edge."""
    n, t = int(image.shape[0] * scale), np.deg2rad(degrees)
    y, x = (np.mgrid[0:n, 0:n] - (n - 1) / 2) / scale
    u, v = (np.clip(c + (image.shape[0] - 1) / 2, 0, image.shape[0] - 1.001) for c in (np.cos(t) * x - np.sin(t) * y, np.sin(t) * x + np.cos(t) * y))
    x0, y0 = u.astype(int), v.astype(int)
    fx, fy = u - x0, v - y0
    return (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy


def recompressed(image, step=40):
    """``image`` after coarse quantisation of the cosine transform of its 8 x 8 blocks, coarser at high frequencies."""
    k, n = np.mgrid[0:8, 0:8]
    basis = np.cos(np.pi * (2 * n + 1) * k / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    blocks = image.reshape(image.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    steps = step * (1 + k + n) / 4
    back = basis.T @ (np.rint(basis @ blocks @ basis.T / steps) * steps) @ basis
    return back.transpose(0, 2, 1, 3).reshape(image.shape)


def test_resized_turned_and_recompressed_copies_meet(spark):
    rng, rows = np.random.default_rng(8), []
    edits = (lambda x: x, lambda x: turned_and_sized(x, 0, 1.5), lambda x: turned_and_sized(x, 17, 1), lambda x: turned_and_sized(x, 33, 1.2), recompressed)
    for n in range(6):
        big = np.clip(media._shrunk(rng.normal(0, 0.125, (16, 16)).astype(np.float32), 1 / 6) * 360 + 128, 0, 255)
        for k, edit in enumerate(edits):
            x = np.rint(np.clip(edit(big), 0, 255)).astype(np.uint8)
            rows.append((10 * n + k, x.shape[1], x.shape[0], np.ascontiguousarray(x).tobytes()))
    got = {r["media_id"]: r["group_id"] for r in media.copy_groups(spark.createDataFrame(rows, "media_id long, width int, height int, pixels binary")).collect()}
    assert got == {10 * n + k: 10 * n for n in range(6) for k in range(len(edits))}


def test_every_member_of_a_class_is_tried(spark, monkeypatch):
    """1 and 2 are linked by their first corners; 3 shares the other corners with both, but only in 2 do they lie alike."""
    rng = np.random.default_rng(4)
    points = np.zeros(36, media.POINT)
    points["x"], points["y"], points["scale"], points["bits"] = *rng.uniform(0, 400, (2, 36)), 1, rng.integers(0, 256, (36, media.TESTS // 8))
    first, second, third = points[:24].copy(), points[:24].copy(), points[12:36].copy()
    first["x"][12:], first["y"][12:] = rng.uniform(0, 400, (2, 12))
    assert [media.consensus(*p) >= 8 for p in ((first, second), (second, third), (first, third))] == [True, True, False]
    monkeypatch.setattr(media, "describe", lambda df: df.select("media", F.lit(24).cast("long").alias("n_keypoints"), F.col("pixels").alias("points")))
    rows = spark.createDataFrame([(k + 1, 1, 1, p.tobytes()) for k, p in enumerate((first, second, third))], "media_id long, width int, height int, pixels binary")
    for star in (1, 16):
        assert {r["media_id"]: r["group_id"] for r in media.copy_groups(rows, star=star).collect()} == {1: 1, 2: 1, 3: 1}


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """Every two blocks meet once, an image is shuffled four times a round at most, and no shuffle files pile up over the rounds."""
    for blocks in (8, 9, 21):
        met = [tuple(sorted((k, (k + apart) % blocks))) for some in media.rounds(blocks) for apart in some for k in range(blocks)]
        assert set(met) == {(i, j) for j in range(blocks) for i in range(j + 1)}
        assert all(len({(k + way * apart) % blocks for apart in some for way in (1, -1)}) <= 4 for some in media.rounds(blocks) for k in range(blocks))
    rng, written = np.random.default_rng(5), []
    rows = []
    for k in range(40):
        points = np.zeros(12, media.POINT)
        points["x"], points["y"], points["scale"] = *rng.uniform(0, 90, (2, 12)), 1
        points["bits"] = rng.integers(0, 256, (12, media.TESTS // 8))
        rows += [(2 * k, 2 * k, 12, bytearray(points.tobytes())), (2 * k + 1, 2 * k + 1, 12, bytearray(points.tobytes()))]
    described = spark.createDataFrame(rows, "media long, class long, n_keypoints long, points binary")
    monkeypatch.setattr(media, "cut", lambda df, clear=False, cut=media.cut: written.append(clear) or cut(df, clear))
    found = {tuple(sorted(r)) for r in media.block_pairs(described, 3, 8, 0.15, 80).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(40)}
    assert written == [True] * (1 + len(media.rounds(12)))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
