"""Pixel operators against independent plain-Python implementations on small random rasters."""

from __future__ import annotations

import math
import random

import pytest

from celstack.operators import compose, graph, layers, pixels

W, H = 9, 7
SCHEMA = "image_id bigint, x int, y int, r int, g int, b int, a int"


def raster(seed: int, w: int = W, h: int = H, alphas=(0, 0, 20, 90, 200, 255, 255)):
    rng = random.Random(seed)
    return {(x, y): (rng.randrange(256), rng.randrange(256), rng.randrange(256), rng.choice(alphas)) for y in range(h) for x in range(w)}


def frame(spark, images: dict[int, dict]):
    return spark.createDataFrame([(i, x, y, *p) for i, px in images.items() for (x, y), p in px.items()], SCHEMA)


def as_dict(df, value="v"):
    return {(r["image_id"], r["x"], r["y"]): r[value] for r in df.collect()}


def over(base, top):
    sa, ba = top[3], base[3]
    if sa == 0:
        return base
    if sa == 255:
        return top
    out = sa + (ba * (255 - sa) + 127) // 255
    return tuple(min(255, (top[c] * sa * 255 + base[c] * ba * (255 - sa)) // (out * 255)) for c in range(3)) + (out,)


def test_layers_of_one_draw_order_all_paint_by_rank(spark):
    stack = {rank: raster(rank) for rank in (3, 1, 2)}
    rows = [(0, x, y, 5, rank, *p) for rank, px in stack.items() for (x, y), p in px.items()]
    df = spark.createDataFrame(rows, "image_id bigint, x int, y int, draw_order int, layer_rank int, r int, g int, b int, a int")
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in compose.composite_over(df).collect()}
    assert all(got.get(at, (0, 0, 0, 0)) == over(over(over((0, 0, 0, 0), stack[1][at]), stack[2][at]), stack[3][at]) for at in stack[1])
    twice = spark.createDataFrame([(0, 0, 0, 5, 10, 10, 10, 128), (0, 0, 0, 5, 10, 10, 10, 128)], "image_id bigint, x int, y int, draw_order int, r int, g int, b int, a int")
    assert compose.composite_over(twice).collect()[0]["a"] == 128 + (128 * 127 + 127) // 255


def test_composite_is_an_ordered_fold(spark):
    stack = {order: raster(order) for order in (1, 2, 5, 9)}
    rows = [(0, x, y, order, *p) for order, px in stack.items() for (x, y), p in px.items()]
    df = spark.createDataFrame(rows, "image_id bigint, x int, y int, draw_order int, r int, g int, b int, a int")
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in compose.composite_over(df).collect()}
    for at in stack[1]:
        want = (0, 0, 0, 0)
        for order in sorted(stack):
            want = over(want, stack[order][at])
        assert got.get(at, (0, 0, 0, 0)) == want


def brute_window(values, radius, reduce):
    rows = {(x, y): reduce([values[i, y] for i in range(max(0, x - radius), min(W, x + radius + 1))]) for x, y in values}
    return {(x, y): reduce([rows[x, j] for j in range(max(0, y - radius), min(H, y + radius + 1))]) for x, y in values}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_dilate_and_feather(spark, radius):
    px = raster(radius)
    mask = pixels.alpha_mask(frame(spark, {0: px}))
    values = {at: p[3] for at, p in px.items()}
    dilated = as_dict(pixels.dilate(mask, radius))
    feathered = as_dict(pixels.feather(mask, radius))
    for at in px:
        assert dilated[0, *at] == brute_window(values, radius, max)[at]
        assert feathered[0, *at] == brute_window(values, radius, lambda v: sum(v) // len(v))[at]


def test_variable_radius_dilation_equals_window_dilation(spark):
    from pyspark.sql import functions as F

    px = raster(3)
    df = frame(spark, {0: px}).withColumn("hit", F.when(F.col("a") > 200, 1).otherwise(0))
    for radius in (0, 1, 3):
        got = as_dict(layers.dilate_binary(df, ["image_id"], "hit", F.lit(radius), "near"), "near")
        want = brute_window({at: p[3] > 200 for at, p in px.items()}, radius, any)
        assert {k[1:]: v for k, v in got.items()} == want


def test_pack_explode_round_trip_and_orientations(spark):
    px = raster(5)
    df = frame(spark, {0: px})
    packed = pixels.pack_pixels(df)
    assert {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in pixels.explode_pixels(packed).collect()} == px
    # each orientation is a bijection; 6 is a clockwise quarter turn: the left column becomes the top row
    for o in range(1, 9):
        dims = spark.createDataFrame([(0, W, H, o)], "image_id bigint, width int, height int, orientation int")
        got = {(r["x"], r["y"]) for r in pixels.orient(df, dims).collect()}
        w, h = (H, W) if o >= 5 else (W, H)
        assert got == {(x, y) for x in range(w) for y in range(h)}
    dims = spark.createDataFrame([(0, W, H, 6)], "image_id bigint, width int, height int, orientation int")
    turned = {(r["x"], r["y"]): r["a"] for r in pixels.orient(df, dims).collect()}
    assert all(turned[H - 1 - y, 0] == px[0, y][3] for y in range(H))


def filtered(values, n, side, kind):
    """One-axis resampling of a list: box when shrinking, triangle when growing."""
    out = []
    for t in range(side):
        if kind == "box":
            w = [max(0.0, min(s + 1, (t + 1) * n / side) - max(s, t * n / side)) for s in range(n)]
        else:
            w = [max(0.0, 1.0 - abs((t + 0.5) * n / side - (s + 0.5))) for s in range(n)]
        out.append([x / sum(w) for x in w])
    return [sum(wi * v for wi, v in zip(w, values)) for w in out]


@pytest.mark.parametrize("side", [4, 9, 16])
def test_square_resample_within_one(spark, side):
    px = raster(11)
    dims = spark.createDataFrame([(0, W, H)], "image_id bigint, width int, height int")
    got = as_dict(pixels.square_resample(frame(spark, {0: px}), dims, side), "a")
    top = (W - H) // 2
    grid = [[px[x, y - top][3] if 0 <= y - top < H else 0 for x in range(W)] for y in range(W)]
    kind = "box" if W >= side else "bilinear"
    rows = [filtered(r, W, side, kind) for r in grid]
    columns = [filtered([rows[y][x] for y in range(W)], W, side, kind) for x in range(side)]
    for x in range(side):
        for y in range(side):
            assert abs(got.get((0, x, y), 0) - columns[x][y]) <= 1


def flood(cells, seeds):
    seen, todo = set(seeds) & cells, list(set(seeds) & cells)
    while todo:
        x, y = todo.pop()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def test_components_match_flood(spark):
    images = {i: raster(i, 23, 17, (0, 255)) for i in range(3)}
    df = frame(spark, images).where("a > 0").select("image_id", "x", "y")
    got = {}
    for r in graph.components4(df, ["image_id"]).collect():
        got.setdefault((r["image_id"], r["start"]), set()).add((r["x"], r["y"]))
    for i, px in images.items():
        cells = {at for at, p in px.items() if p[3]}
        want = set()
        while cells:
            seed = min(cells, key=lambda c: (c[1], c[0]))
            part = flood(cells, {seed})
            want.add((seed[1] * 4294967296 + seed[0], frozenset(part)))
            cells -= part
        assert {(start, frozenset(c)) for (image, start), c in got.items() if image == i} == want


def test_snake_component_converges(spark):
    """A one-pixel spiral-like path is one component although its diameter is its size."""
    path = [(x, y) for y in range(0, 40, 4) for x in range(30)] + [(29, y + d) for y in range(0, 36, 8) for d in (1, 2, 3)] + [(0, y + d) for y in range(4, 36, 8) for d in (1, 2, 3)]
    df = spark.createDataFrame([(0, x, y) for x, y in set(path)], "image_id bigint, x int, y int")
    assert graph.components4(df, ["image_id"]).select("start").distinct().count() == 1


def brute_fill(known, target, w, h):
    from collections import OrderedDict

    frontier = OrderedDict()
    for y in range(h):
        for x in range(w):
            if (x, y) in known:
                frontier[x, y] = (x, y)
    origin = dict(frontier)
    while frontier:
        after = OrderedDict()
        for (x, y), o in frontier.items():
            for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                n = (x + dx, y + dy)
                if n in target and n not in origin:
                    origin[n] = o
                    after[n] = o
        frontier = after
    return {at: o for at, o in origin.items() if at not in known}


def test_nearest_fill_ties(spark):
    rng = random.Random(1)
    w, h = 15, 11
    known = {(rng.randrange(w), rng.randrange(h)) for _ in range(9)}
    target = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.85} - known
    colour = {k: i for i, k in enumerate(sorted(known))}
    k = spark.createDataFrame([(0, x, y, colour[x, y], 0, 0) for x, y in known], "image_id bigint, x int, y int, r int, g int, b int")
    t = spark.createDataFrame([(0, x, y, 255) for x, y in target], "image_id bigint, x int, y int, v int")
    got = {(r["x"], r["y"]): r["r"] for r in graph.nearest_fill(k, t, ["image_id"]).collect()}
    assert got == {at: colour[o] for at, o in brute_fill(known, target, w, h).items()}


def test_layout_keeps_sides_and_minimum_size(spark):
    box = spark.createDataFrame([(0, 10, 20, 100, 200), (1, 0, 0, 1, 1)], "image_id bigint, x int, y int, width int, height int")
    rows = layers.layout_regions(box).collect()
    assert len(rows) == 22 and all(r["width"] >= 1 and r["height"] >= 1 for r in rows)
    by = {r["slot_id"]: r for r in rows if r["image_id"] == 0}
    assert by["eye.left"]["x"] > by["eye.right"]["x"]
    assert by["torso"]["y"] + by["torso"]["height"] == 220
    assert math.isclose(by["hair.back"]["width"], round(100 * 0.58 * 1.24))
