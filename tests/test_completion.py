"""Bounded completion end to end on small layers, and pose coverage verdicts."""

from __future__ import annotations

import random

from celstack.functions import fixed
from celstack.operators import graph, layers, motion
from celstack.plans import inputs as I
from celstack.plans import load
from celstack.plans.layers import layer_textures

W = H = 40


def test_layer_textures(spark):
    """Visible pixels keep the source; generated pixels are hidden, coloured by the nearest visible pixel, and feathered."""
    rng = random.Random(8)
    source = {(x, y): (rng.randrange(256), rng.randrange(256), rng.randrange(256), 255) for x in range(W) for y in range(H)}
    subject = {at for at in source if 2 <= at[0] < 38 and 2 <= at[1] < 38}
    back = {at for at in subject if at[0] < 18}
    front = {at for at in subject if 15 <= at[0] < 30 and 10 <= at[1] < 30}
    rows = [(0, "face.base", x, y, 255, 70) for x, y in back - front] + [(0, "hair.front", x, y, 255, 120) for x, y in front]
    masks = spark.createDataFrame(rows, "image_id bigint, slot_id string, x int, y int, v int, draw_order int")
    sdf = spark.createDataFrame([(0, x, y, *p) for (x, y), p in source.items()], "image_id bigint, x int, y int, r int, g int, b int, a int")
    inside = spark.createDataFrame([(0, x, y, 255) for x, y in subject], "image_id bigint, x int, y int, v int")
    dims = spark.createDataFrame([(0, W, H)], "image_id bigint, width int, height int")
    reveal = layers.reveal_target(masks, inside, dims)
    soft = layers.soften_generated(reveal, dims, 3)
    visible = back - front
    near = lambda at: any(abs(at[0] - x) <= 16 and abs(at[1] - y) <= 16 for x, y in visible)
    target = {at for at in front if near(at)}
    got = {(r["x"], r["y"]): r for r in soft.where("slot_id = 'face.base'").collect()}
    assert {at for at, r in got.items() if r["target"] > 0} == target and {at for at, r in got.items() if r["visible"] == 1} == visible
    assert not any(r["target"] for r in soft.where("slot_id = 'hair.front'").collect())

    def box(values, axis):
        out = {}
        for x, y in ((x, y) for x in range(W) for y in range(H)):
            line = [values.get((x + d, y) if axis == 0 else (x, y + d), 0) for d in range(-3, 4) if 0 <= (x if axis == 0 else y) + d < (W if axis == 0 else H)]
            out[x, y] = sum(line) // len(line)
        return out

    feathered = box(box({at: 255 for at in target}, 0), 1)
    assert all(got[at]["generated"] == min(255, feathered[at]) for at in target)
    textures = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in layer_textures(sdf, soft).where("slot_id = 'face.base'").collect()}
    assert all(textures[at] == source[at] for at in visible)
    filled = {at: c for at, c in textures.items() if at in target}
    colours = {source[at][:3] for at in visible}
    assert filled and all(c[:3] in colours for c in filled.values())
    # a target pixel beside visible pixels takes the colour of one of them
    for (x, y), c in filled.items():
        beside = {source[n][:3] for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if n in visible}
        assert not beside or c[:3] in beside


def test_reveal_across_words(spark):
    """Lines wider than 64 pixels against a plain loop; a pixel beside the margin is never made a row of its own."""
    rng, width, height, margins = random.Random(3), 150, 9, {"eye.left": 10, "mouth": 12}
    order = {"eye.left": 999, "mouth": 5, "face.base": 2000}
    masks = [(0, s, x, y, 255, order[s]) for s in margins for x, y in {(rng.choice([0, 1, 62, 63, 64, 65, 126, 127, 128, 149]), rng.randrange(height)) for _ in range(6)}]
    masks += [(0, "face.base", x, y, 255, 2000) for x in range(width) for y in range(height) if rng.random() < 0.5] + [(0, "mouth", 150, 2, 255, 5), (1, "mouth", 1, 1, 255, 5)]
    subject = {(x, y): rng.choice([0, 40, 255, 300]) for x in range(width) for y in range(height)}
    got = layers.reveal_target(
        spark.createDataFrame(masks, "image_id bigint, slot_id string, x int, y int, v int, draw_order int"),
        spark.createDataFrame([(0, x, y, v) for (x, y), v in subject.items()], "image_id bigint, x int, y int, v int"),
        spark.createDataFrame([(0, width, height)], "image_id bigint, width int, height int"))
    wanted, known = set(), set(masks)
    for slot in order:
        seen = {(x, y) for image, s, x, y, *_ in masks if s == slot and x < width and image == 0}
        wanted |= {(0, slot, x, y, 1, 0) for x, y in seen}
        for x, y in subject:
            near = any(abs(x - a) <= fixed.REVEAL_MARGINS[slot] and abs(y - b) <= fixed.REVEAL_MARGINS[slot] for a, b in seen)
            covered = any((0, s, x, y, 255, order[s]) in known for s in order if order[s] > fixed.DRAW_ORDER[slot])
            if near and covered and (x, y) not in seen and subject[x, y] > 0:
                wanted.add((0, slot, x, y, 0, min(255, subject[x, y])))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    assert any(r[5] == 40 for r in wanted) and "Window" not in got._jdf.queryExecution().toString()


def test_unreached_target_keeps_the_source_alpha(spark):
    """A target cell that no fill reaches: source alpha 255 under coverage 200 is 200, not 0."""
    source = spark.createDataFrame([(0, 5, 5, 10, 20, 30, 255)], "image_id bigint, x int, y int, r int, g int, b int, a int")
    filled = spark.createDataFrame([], "image_id bigint, slot_id string, x int, y int, r int, g int, b int, a int")
    soft = spark.createDataFrame([(0, "s", 5, 5, 0, 255, 200)], "image_id bigint, slot_id string, x int, y int, visible int, target int, coverage int")
    assert [tuple(r)[4:] for r in layers.soften_texture(filled, source, soft).collect()] == [(10, 20, 30, 200)]


def test_pose_coverage_verdicts(spark):
    poses = spark.createDataFrame([(1, p) for p in ("neutral", "same", "thin", "gone", "wild")], "image_id bigint, pose string")
    counts = {"neutral": 40, "same": 40, "thin": 9, "wild": 40}
    rendered = spark.createDataFrame([(1, p, i, 0, 0, 0, 0, 200) for p, n in counts.items() for i in range(n)] + [(1, "gone", 0, 0, 0, 0, 0, 31)],
                                     "image_id bigint, pose string, x int, y int, r int, g int, b int, a int")
    vertices = spark.createDataFrame([(1, p, 2e6 if p == "wild" else 1.0, 1.0) for p in counts], "image_id bigint, pose string, x double, y double")
    got = {r["pose"]: r["status"] for r in motion.pose_coverage(rendered, poses, vertices).collect()}
    assert got == {"neutral": "ok", "same": "ok", "thin": "review", "gone": "blocking", "wild": "blocking"}


def test_nearest_fill_reaches_every_column(spark):
    folder = "/root/testdata/sf0.001"
    pixels = I.pixels(spark, folder)
    known = pixels.where("a > 200").select("image_id").distinct()
    wanted = pixels.where("a <= 200").join(known, "image_id", "left_semi").groupBy("x").count().collect()
    got = load()["nearest_fill"].run(spark, folder).join(known, "image_id", "left_semi").groupBy("x").count().collect()
    assert sorted(got) == sorted(wanted) and min(r["x"] for r in got) == 0 and max(r["x"] for r in got) > 60


def test_nearest_fill_along_a_corridor(spark):
    """A winding way through several tiles against a plain search, in fewer jobs than it has levels."""
    way = [(x, y) for y in range(0, 12, 2) for x in (range(150) if y % 4 == 0 else range(149, -1, -1))]
    way = [at for i, at in enumerate(way) for at in ([at, (at[0], at[1] + 1)] if (i + 1) % 150 == 0 else [at])]
    known = {way[0]: 7, way[400]: 9}
    k = spark.createDataFrame([(0, x, y, r, 2, 3) for (x, y), r in known.items()], "image_id bigint, x int, y int, r int, g int, b int")
    t = spark.createDataFrame([(0, x, y, 200) for x, y in way], "image_id bigint, x int, y int, v int")
    level, colour, front = dict.fromkeys(known, 0), dict(known), sorted(known, key=lambda at: (at[1], at[0]))
    while front:
        reached = {}
        for x, y in front:
            for to in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if to in set(way) and to not in level and to not in reached:
                    reached[to] = (x, y)
        for to, by in reached.items():
            level[to], colour[to] = level[by] + 1, colour[by]
        front = list(reached)
    spark.sparkContext.setJobGroup("corridor", "corridor")
    got = {(r["x"], r["y"]): (r["r"], r["level"]) for r in graph.nearest_fill(k, t, ["image_id"]).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("corridor"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {at: (colour[at], level[at]) for at in level if at not in known}
    assert max(level.values()) > 400 and jobs < 300
