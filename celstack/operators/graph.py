"""Connected components, reachability, nearest fill and cycle checks as loops of joins, combinable aggregates and bounded tiles.

Pixel graphs are contracted before the loop: horizontal runs become the nodes, and an edge joins two runs that touch
vertically, found by an equi-join on the shared pixel coordinate. Loops write a table in the shared checkpoint folder
every round and stop by the data; an explicit round limit fails loudly instead of returning a partial answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .pixels import PX


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of the component of every node that has an edge; ``edges`` is (a, b) of one orderable type.

    Each round hooks every node to its smallest neighbour, follows pointers to their roots by doubling, and contracts the
    edge list onto the roots. Only nodes smaller than all their neighbours survive a round, at most half of them, so the
    edges shrink geometrically, and copies of an edge at a hot node disappear in the next distinct.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        parent = _to_roots(cut(parent))
        steps.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("connected components did not converge within the round limit")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # compose the per-round parents from the last round back; each later map covers ever fewer nodes
    labels = steps[-1].select("node", F.col("p").alias("component"))
    for parent in reversed(steps[:-1]):
        up = labels.select(F.col("node").alias("p"), "component")
        labels = parent.join(up, "p", "left").select("node", F.coalesce("component", "p").alias("component"))
    return labels


def _to_roots(parent: DataFrame, max_jumps: int = 64) -> DataFrame:
    """Pointer doubling, two doublings per written table, until every ``(node, p)`` points at a root (roots at themselves)."""
    for _ in range(max_jumps):
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        twice = parent.join(up, "p").select("node", "p", "pp")
        further = twice.select(F.col("node").alias("pp"), F.col("pp").alias("p4"))
        jumped = cut(twice.join(further, "pp").select("node", "p", "p4"))
        moved = not jumped.where("p <> p4").isEmpty()
        parent = jumped.select("node", F.col("p4").alias("p"))
        if not moved:
            return parent
    raise RuntimeError("pointer chains are longer than the jump limit allows")


def pixel_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Label horizontal runs of cells ``(keys, x, y)`` by their first x.

    Gaps and islands: inside one raster line (at most one canvas side long) x minus its row number is constant on a run.
    """
    line = Window.partitionBy(*keys, "y").orderBy("x")
    island = cells.withColumn("__i", F.col("x") - F.row_number().over(line))
    return island.withColumn("run_x", F.min("x").over(Window.partitionBy(*keys, "y", "__i"))).drop("__i")


def components4(cells: DataFrame, keys: list[str]) -> DataFrame:
    """4-connected component of every cell: adds ``start`` (row-major smallest cell as ``y * 2^32 + x``)."""
    node = F.struct(*keys, (F.col("y").cast("bigint") * 4294967296 + F.col("run_x")).alias("at"))
    runs = cut(pixel_runs(cells, keys).withColumn("node", node))
    below = runs.select(*keys, "x", (F.col("y") - 1).alias("y"), F.col("node").alias("b"))
    edges = runs.select(*keys, "x", "y", F.col("node").alias("a")).join(below, [*keys, "x", "y"]).select("a", "b").distinct()
    labels = connected_components(edges)
    joined = runs.join(labels, "node", "left").withColumn("start", F.coalesce(F.col("component.at"), F.col("node.at")))
    return joined.drop("node", "component", "run_x")


def component_facts(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of components, median and largest size, start of the largest (ties to the smallest start).

    The exact median keeps a count per distinct component size, of which an image of n pixels has fewer than sqrt(2n).
    """
    sizes = labelled.groupBy(*keys, "start").agg(F.count("*").alias("size"))
    return sizes.groupBy(*keys).agg(
        F.count("*").alias("components"), F.percentile("size", F.lit(0.5)).alias("median_size"), F.max("size").alias("largest"),
        F.min(F.struct((-F.col("size")).alias("s"), "start")).getField("start").alias("largest_start"))


def largest_composition(labelled: DataFrame, facts: DataFrame, group: str = "grp") -> DataFrame:
    """Pixels of each group inside the largest component, with dominance and mixture labels."""
    top = facts.select("image_id", F.col("largest_start").alias("start"))
    inside = labelled.join(top, ["image_id", "start"]).groupBy("image_id").agg(
        F.count_if(F.col(group) == "H1").alias("h1"), F.count_if(F.col(group) == "H2").alias("h2"))
    return inside.select("image_id", "h1", "h2", F.expr("case when h1 = h2 then 'tie' when h1 > h2 then 'H1' else 'H2' end").alias("dominant"),
                         F.expr("if(h1 > 0 and h2 > 0, 'mixed', 'single_group')").alias("composition"))


def reached_from(cells: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose 4-connected component contains a seed: components once, no flood front to iterate."""
    labelled = cut(components4(cells, keys))
    hit = labelled.join(seeds.select(*keys, "x", "y").distinct(), [*keys, "x", "y"]).select(*keys, "start").distinct()
    return labelled.join(hit, [*keys, "start"], "left_semi")


def subject_matte(pixels: DataFrame, images: DataFrame, threshold: int = 248, reach: int = 2) -> DataFrame:
    """255 inside the subject, 0 within ``reach`` of the exterior: the low-alpha region connected to the canvas border."""
    from .layers import dilate_binary

    dims = images.select("image_id", "width", "height")
    low = pixels.where(F.col("a") < threshold).select(*PX)
    border = low.join(dims, "image_id").where("x = 0 or y = 0 or x = width - 1 or y = height - 1").select(*PX)
    exterior = reached_from(low, border, ["image_id"]).select(*PX, F.lit(1).alias("out"))
    grid = pixels.select(*PX).join(exterior, PX, "left").na.fill(0, ["out"])
    near = dilate_binary(grid, ["image_id"], "out", F.lit(reach), "near")
    return near.select(*PX, F.when(F.col("near"), 0).otherwise(255).alias("v"))


def fill_holes(pixels: DataFrame, threshold: int = 15, opaque: int = 240, reach: int = 2) -> DataFrame:
    """Paint holes (low alpha not reached from the top-left pixel), grown by ``reach``, with the mean opaque colour.

    Returns every pixel with its new value and whether it belongs to the painted mask. If the top-left pixel itself is
    visible, the visible region connected to it is what the flood replaces, so every low-alpha pixel is a hole.
    """
    from .layers import dilate_binary

    low = pixels.where(F.col("a") <= threshold).select(*PX)
    outside = reached_from(low, low.where("x = 0 and y = 0"), ["image_id"]).select(*PX, F.lit(True).alias("outer"))
    marked = pixels.join(outside, PX, "left").withColumn("hole", F.when((F.col("a") <= threshold) & F.col("outer").isNull(), 1).otherwise(0)).drop("outer")
    grown = dilate_binary(marked, ["image_id"], "hole", F.lit(reach), "painted").drop("hole")
    means = pixels.where(F.col("a") >= opaque).groupBy("image_id").agg(*[F.bround(F.sum(c) / F.count(c)).cast("int").alias(f"m{c}") for c in "rgb"])
    joined = grown.join(means, "image_id", "left")
    colours = [F.when(F.col("painted"), F.coalesce(F.col(f"m{c}"), F.lit(0))).otherwise(F.col(c)).alias(c) for c in "rgb"]
    return joined.select(*PX, *colours, F.when(F.col("painted"), 255).otherwise(F.col("a")).alias("a"), "painted")


DIRECTIONS = ((1, 0), (-1, 0), (0, 1), (0, -1))
TILE = 64
UNREACHED = 2**31 - 1


def _filled_tiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Settle every 64 x 64 tile of ``cells`` by itself: its open cells as they are now, and offers to the cells beside the tile.

    ``cells``: (keys, x, y, v, level, seed, colour, kind) with kind 0 for open cells, 1 for known cells and 2 for offers of a level.
    """
    fields = ["x", "y", "v", "level", "seed", "colour", "kind"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    tiled = cells.select(*keys, F.expr("shiftright(x, 6)").alias("tx"), F.expr("shiftright(y, 6)").alias("ty"), *fields)
    across = TILE + 2

    def settle(level: np.ndarray, seed: np.ndarray, colour: np.ndarray, free: np.ndarray, changed: np.ndarray) -> None:
        """Lower (level, seed) of the ``free`` cells of one flat tile with a rim, in place, from its ``changed`` cells on, level by level."""
        if not changed.any():
            return
        at = int(level[changed].min())
        while True:
            front = np.flatnonzero(changed & (level == at))
            for dx, dy in DIRECTIONS:
                to = front + dx + dy * across
                better = free[to] & ((level[to] > at + 1) | ((level[to] == at + 1) & ((seed[to] > seed[front]) | ((seed[to] == seed[front]) & (colour[to] > colour[front])))))
                to, by = to[better], front[better]
                level[to], seed[to], colour[to], changed[to] = at + 1, seed[by], colour[by], True
            later = level[changed & (level > at)]
            if not len(later):
                return
            at = int(later.min())

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y, v, given, seeds, colours, kind = (table.column(c).to_numpy() for c in fields)
        left, top = key[-2].as_py() * TILE - 1, key[-1].as_py() * TILE - 1
        place = (y - top) * across + (x - left)
        value, known, free = np.zeros(across * across, np.int64), np.zeros(across * across, bool), np.zeros(across * across, bool)
        level, seed, colour = np.full(across * across, UNREACHED, np.int32), np.zeros(across * across, np.int64), np.zeros(across * across, np.int64)
        known[place[kind == 1]] = True
        free[place[kind == 0]] = True
        free &= ~known
        np.maximum.at(value, place[kind == 0], v[kind == 0])
        changed = known.copy()
        for asked in (0, 1, 2):  # the least of what is there, of the colours of a known cell, of the offers to a cell
            rows = np.flatnonzero((kind == asked) & (given < UNREACHED) & (known if asked == 1 else free)[place])
            rows = rows[np.lexsort((colours[rows], seeds[rows], given[rows], place[rows]))]
            rows = rows[np.append(True, np.diff(place[rows]) != 0)] if len(rows) else rows
            to = place[rows]
            better = (level[to] > given[rows]) | ((level[to] == given[rows]) & ((seed[to] > seeds[rows]) | ((seed[to] == seeds[rows]) & (colour[to] > colours[rows]))))
            rows, to = rows[better], to[better]
            level[to], seed[to], colour[to] = given[rows], seeds[rows], colours[rows]
            if asked == 2:
                changed[to] = True
        settle(level, seed, colour, free, changed)
        own = np.flatnonzero(free)
        parts = [(own % across + left, own // across + top, value[own], level[own], seed[own], colour[own], 0)]
        told = np.flatnonzero(changed)
        tx, ty = told % across, told // across
        for dx, dy in DIRECTIONS:
            out = (tx + dx == 0) | (tx + dx == TILE + 1) | (ty + dy == 0) | (ty + dy == TILE + 1)
            by = told[out]
            parts.append((tx[out] + dx + left, ty[out] + dy + top, np.zeros(len(by), np.int64), level[by] + 1, seed[by], colour[by], 2))
        size = sum(len(part[0]) for part in parts)
        columns = [np.concatenate([part[i] for part in parts]) for i in range(6)] + [np.concatenate([np.full(len(part[0]), part[6]) for part in parts])]
        return pa.Table.from_arrays([pa.repeat(k, size) for k in key[:-2]] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, *fields])

    return tiled.groupBy(*keys, "tx", "ty").applyInArrow(run, cells.select(*keys, *fields).schema)


def nearest_fill(known: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Colour of the breadth-first nearest known cell for every reachable target cell; of several the first in row-major order.

    Tiles of 64 x 64 cells are settled by themselves; what a tile offers to cells of the tiles beside it settles those again where it is
    nearer or comes first, until no offer is. ``known``: (keys, x, y, r, g, b); ``target``: (keys, x, y, v).
    """
    at = [*keys, "x", "y"]
    present = " and ".join(f"{c} is not null" for c in at)
    place = [*keys, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")]
    start = known.where(present).select(*place, F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("level"), F.expr("cast(y as bigint) * 4294967296 + x").alias("seed"),
                                        F.expr("shiftleft(cast(r as bigint), 32) + shiftleft(cast(g as bigint), 16) + b").alias("colour"), F.lit(1).alias("kind"))
    zero = F.lit(0).cast("bigint")
    wanted = target.where(f"v > 0 and {present}").select(*place, F.col("v").cast("bigint").alias("v"), F.lit(UNREACHED).alias("level"), zero.alias("seed"), zero.alias("colour"), F.lit(0).alias("kind"))
    settled = cut(_filled_tiles(start.unionByName(wanted), keys))
    while True:
        cells, offers = settled.where("kind = 0"), settled.where("kind = 2")
        now = cells.select(*at, F.struct("level", "seed", "colour").alias("now"))
        nearer = cut(offers.join(now, at).where("struct(level, seed, colour) < now").drop("now"))
        if nearer.isEmpty():
            break
        tile = [*keys, F.expr("shiftright(x, 6)").alias("tx"), F.expr("shiftright(y, 6)").alias("ty")]
        tiles = cut(nearer.select(*tile).distinct())
        placed = cells.select("*", *tile[len(keys):])
        again = placed.join(tiles, [*keys, "tx", "ty"], "left_semi").select(*settled.columns)
        rest = placed.join(tiles, [*keys, "tx", "ty"], "left_anti").select(*settled.columns)
        settled = cut(_filled_tiles(again.unionByName(nearer), keys).unionByName(rest))
    kinds = dict(known.dtypes)
    colours = [F.expr(f"cast(shiftright(colour, {shift}) & 65535 as {kinds[c]})").alias(c) for c, shift in (("r", 32), ("g", 16), ("b", 0))]
    return settled.where(f"kind = 0 and level < {UNREACHED}").select(
        *keys, F.col("x").cast(kinds["x"]).alias("x"), F.col("y").cast(kinds["y"]).alias("y"), *colours, F.col("v").cast(dict(target.dtypes)["v"]).alias("a"), "level")


def cyclic_graphs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the graphs of ``edges`` (keys, behind, front) that have a cycle.

    A round drops edges at nodes without incoming or without outgoing edges. A graph that loses none has a cycle, since every one of its
    nodes leads on. In the others a node with one predecessor is merged into it, along whole chains and trees at once by pointer doubling,
    and likewise a node with one successor: neither makes nor breaks a cycle, adds no edge, and a cycle shrinks to an edge from a node to
    itself. Chains and trees of any depth are gone after one round; only graphs that stay wide everywhere take a round for each level.
    """
    graph = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    live = cut(edges.select(graph.alias("g"), F.col("behind").alias("a"), F.col("front").alias("b")).distinct())
    found: list[DataFrame] = []

    def without(rows: DataFrame, graphs: DataFrame) -> DataFrame:
        found.append(graphs)
        return rows.join(graphs, "g", "left_anti")

    while not live.isEmpty():
        live = without(live, cut(live.where("a = b").select("g").distinct()))
        starts, ends = live.select("g", F.col("a").alias("b")).distinct(), live.select("g", F.col("b").alias("a")).distinct()
        kept = cut(live.join(starts, ["g", "b"], "left_semi").join(ends, ["g", "a"], "left_semi").select("g", "a", "b"))
        sizes = live.groupBy("g").agg(F.count("*").alias("before")).join(kept.groupBy("g").agg(F.count("*").alias("after")), "g")
        live = cut(without(kept, cut(sizes.where("before = after").select("g"))))
        for end, other in (("b", "a"), ("a", "b")):
            single = live.groupBy("g", F.col(end).alias("node")).agg(F.min(other).alias("p"), F.count("*").alias("n")).where("n = 1").drop("n")
            roots, turning = _ends_of_chains(single)
            live = without(live, turning)
            merged = live.join(roots.select("g", F.col("node").alias(end)), ["g", end], "left_anti")
            moved = merged.join(roots.select("g", F.col("node").alias(other), "p"), ["g", other], "left").withColumn(other, F.coalesce("p", other))
            live = cut(moved.select("g", "a", "b").distinct())
    names = [F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)]
    out = edges.select(*keys).limit(0)
    for graphs in found:
        out = out.unionByName(graphs.select(*names))
    return out.distinct()


def _ends_of_chains(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the pointers (g, node, p) lead in the end, and the graphs in which some pointers turn in a circle."""
    pointers = cut(pointers.withColumn("open", F.lit(True)))
    for _ in range(max(1, pointers.count().bit_length()) + 2):
        if pointers.where("open").isEmpty():
            break
        onward = pointers.select("g", F.col("node").alias("p"), F.col("p").alias("further"))
        jumped = pointers.join(onward, ["g", "p"], "left")
        pointers = cut(jumped.select("g", "node", F.coalesce("further", "p").alias("p"), F.col("further").isNotNull().alias("open")))
    return pointers.where("not open").select("g", "node", "p"), cut(pointers.where("open").select("g").distinct())


def occlusion_errors(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per graph: edges with a missing node, self edges, and whether the remaining graph has a cycle."""
    known = nodes.select(*keys, "node").distinct()
    behind = known.withColumnRenamed("node", "behind").withColumn("has_behind", F.lit(True))
    front = known.withColumnRenamed("node", "front").withColumn("has_front", F.lit(True))
    marked = cut(edges.join(behind, [*keys, "behind"], "left").join(front, [*keys, "front"], "left").withColumn(
        "problem", F.expr("case when has_behind is null or has_front is null then 'missing' when behind = front then 'self' end")))
    cyclic = cyclic_graphs(marked.where("problem is null"), keys).withColumn("cyclic", F.lit(True))
    counts = marked.groupBy(*keys).agg(F.count_if(F.col("problem") == "missing").alias("missing_node"), F.count_if(F.col("problem") == "self").alias("self_edges"))
    return counts.join(cyclic, keys, "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def parent_chain(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Problems of a parent tree ``(node, parent)``: parents that do not resolve and nodes whose chain enters a cycle.

    Pointer doubling: after k rounds a pointer skips 2^k ancestors, and acyclic nodes run out. When a round retires no
    node, the rest is cyclic, so the number of rounds is logarithmic in the depth.
    """
    unique = nodes.select("node", "parent").distinct()
    broken = unique.where("parent is not null").join(unique.select(F.col("node").alias("parent")).distinct(), "parent", "left_anti")
    live = cut(unique.where("parent is not null").select("node", F.col("parent").alias("anc")))
    size = live.count()
    for _ in range(max_rounds):
        if size == 0:
            break
        up = live.select(F.col("node").alias("anc"), F.col("anc").alias("next"))
        further = cut(live.join(up, "anc").select("node", F.col("next").alias("anc")))
        left = further.count()
        live = further
        if left == size:
            break
        size = left
    else:
        raise RuntimeError("parent chains are deeper than the round limit allows")
    return broken.select("node", F.lit("PARENT_MISSING").alias("problem")).unionByName(live.select("node", F.lit("CYCLE").alias("problem")))
