"""Near-duplicate families against all pairs, on texts and rasters with hot groups."""

import random

import pytest

from celstack.operators import families

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, size=5, num=80, den=100):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts[i] = t if texts.get(i) is None else texts[i] if t is None else min(t, texts[i])
    sets = {i: families.shingles((t or "").encode(), size) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    out = {i: (len(sets[i]), find(i)) for i in ids}
    return {i: (n, f, sum(g == f for _, g in out.values())) for i, (n, f) in out.items()}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 400))
    rows, passage = [], [word() for _ in range(60)]
    for i in range(90):  # one passage in many texts
        own = [word() for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(own[:10] + passage + own[10:])))
    base = [word() for _ in range(300)]
    for i in range(120):  # a large group of near copies, and steps away from it
        changed = list(base)
        for _ in range(rng.randint(0, 14)):
            changed[rng.randrange(len(changed))] = word()
        rows.append((1000 + i, " ".join(changed)))
    rows += [(2000 + i, " ".join(base).upper()) for i in range(40)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one two"), (3004, "ONE  two"), (3005, "one two three"), (None, "one two"), (3006, "one two"), (3006, "zwei"),
             (3007, " ".join(word() for _ in range(30_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [64, 3])
def test_text_families(spark, monkeypatch, hot):
    """With a small bound buckets are split twice; nothing is lost."""
    monkeypatch.setattr(families, "HOT", hot)
    rows = corpus()
    texts = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "item_id long, text string, node int, family string").repartition(3)
    got = {r["item_id"]: (r["n_shingles"], r["family"], r["members"]) for r in families.near_duplicate_families(texts).collect()}
    assert got == brute(rows)
    assert families.near_duplicate_families(texts.where("false")).collect() == []


def test_hashes_are_of_shingles():
    """Equal sets of shingles and only those have equal hashes, whatever the slices."""
    known = families._Hashes()
    for text in (b"", b"a", b"a b", b"A b  c d e f", b"a b c d e f a b c d e f", b"x " * 50):
        assert len(families.shingle_hashes(families.words(text), 5, known)) == len(families.shingles(text, 5))


def pixels_of(raster_id, width, height, shade):
    return [(raster_id, x, y, *shade(x, y), 255) for y in range(height) for x in range(width)]


def test_raster_families(spark):
    """Recoloured and enlarged copies are told from copies; a crop and a sparse raster stay apart; flat ones are one family."""
    rng = random.Random(3)
    hills = [(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(20, 120)) for _ in range(9)]
    height_at = lambda x, y: min(255, int(sum(h / (1 + ((x - a) ** 2 + (y - b) ** 2) / 40) for a, b, h in hills)))
    grey = lambda f: lambda x, y: (f(x, y),) * 3
    made = {
        1: (40, 40, grey(height_at)), 2: (40, 40, grey(height_at)), 3: (40, 40, grey(lambda x, y: height_at(x, y) * 3 // 4 + 20)),
        4: (80, 80, grey(lambda x, y: height_at(x // 2, y // 2))), 5: (26, 40, grey(lambda x, y: height_at(x + 14, y))),
        6: (40, 40, grey(lambda x, y: 255 - height_at(x, y))), 7: (20, 20, grey(lambda x, y: 9)), 8: (30, 20, grey(lambda x, y: 200)), 9: (5, 5, grey(lambda x, y: x)),
        10: (5, 5, grey(lambda x, y: x)), 11: (5, 5, grey(lambda x, y: y)),
    }
    cells = [row for i, (w, h, shade) in made.items() for row in pixels_of(i, w, h, shade)]
    pixels = spark.createDataFrame(cells, "raster_id long, x int, y int, r int, g int, b int, a int").repartition(5)
    rasters = spark.createDataFrame([(i, w, h) for i, (w, h, _) in made.items()] + [(12, 9, 9), (None, 4, 4), (13, 0, 5)], "raster_id long, width int, height int")
    got = {r["raster_id"]: (r["family"], r["members"], r["kind"]) for r in families.raster_families(rasters, pixels).collect()}
    assert got == {
        1: (1, 4, "first"), 2: (1, 4, "copy"), 3: (1, 4, "recoloured"), 4: (1, 4, "resized"), 5: (5, 1, "first"), 6: (6, 1, "first"), 7: (7, 2, "first"), 8: (7, 2, "resized"),
        9: (9, 2, "first"), 10: (9, 2, "copy"), 11: (11, 1, "first"), 12: (12, 1, "first")}


def test_words_within_the_radius_meet(spark, monkeypatch):
    """Random words at distances 0 to 3 of each other: every pair in reach shares a bucket, split or not."""
    rng, base = random.Random(1), [random.Random(9).randrange(1 << 16) for _ in range(4)]
    rows = []
    for i in range(60):
        words = list(base)
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            words[bit // 16] ^= 1 << bit % 16
        rows.append((i, words))
    monkeypatch.setattr(families, "HOT", 2)
    nodes = spark.createDataFrame(rows, "node long, words array<int>")
    keyed = nodes.withColumnRenamed("words", "keys")
    met = nodes.selectExpr("node", "posexplode(words) as (band, word)").selectExpr("xxhash64(band, word) as bucket", "band", "node")
    alone = nodes.selectExpr("node", "node as family")
    pairs = {(r["a"], r["b"]) for r in families.across_families(met, keyed, alone, families.split_by_other_word, 1).collect()}
    near = {(i, j) for i, x in rows for j, y in rows if i < j and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= 3}
    assert near <= pairs and len(near) > 100


def test_sets_of_different_sizes_are_not_verified(spark):
    """Equal signatures, but at 0.8 a set of 8 may meet one of 10 and not one of 11; the other way round likewise."""
    nodes = spark.createDataFrame([(1, 8, bytes(512)), (2, 10, bytes(512)), (3, 11, bytes(512))], "node long, n long, sig binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert sorted(map(tuple, families._agreeing(pairs, nodes, 80, 100).collect())) == [(1, 2), (2, 3)]
