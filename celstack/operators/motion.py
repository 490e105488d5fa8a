"""Meshes, parameters, bindings, poses, frame sequences, affine part motion and raster warping.

Mesh work is keyed by (mesh, vertex) or (mesh, triangle), so a huge mesh spreads over all partitions. Sums of floats are
folded in a defined order, because the results of other orders differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests, fixed
from . import hotkeys
from .compose import composite_over

MESH = ["image_id", "slot_id"]
MANDATORY = tuple(p for p, cap, *_ in fixed.PARAMETERS if cap == "candidate_mandatory")


def f32(text: str) -> str:
    """Value of an expression after a float32 round trip (SQL text)."""
    return f"cast(cast({text} as float) as double)"


def _lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[key], F.lit(default))


def mesh_density(boxes: DataFrame) -> DataFrame:
    columns = {s: c for s, (c, _) in fixed.GRID_DENSITY.items()}
    rows = {s: r for s, (_, r) in fixed.GRID_DENSITY.items()}
    return boxes.withColumn("columns", _lookup(columns, F.col("slot_id"), fixed.DEFAULT_DENSITY[0])).withColumn(
        "rows", _lookup(rows, F.col("slot_id"), fixed.DEFAULT_DENSITY[1]))


def grid_vertices(boxes: DataFrame) -> DataFrame:
    """Grid vertices of boxes ``(image_id, slot_id, x, y, width, height, canvas_width, canvas_height)``, float32, UV over the canvas."""
    d = mesh_density(boxes.where("width > 0 and height > 0"))
    lines = d.select("*", F.explode(F.expr("sequence(0, rows)")).alias("row"))
    cells = lines.select("*", F.explode(F.expr("sequence(0, columns)")).alias("column"))
    px, py = "(x + width * column / columns)", "(y + height * row / rows)"
    return cells.select(
        *MESH, F.expr("row * (columns + 1) + column").alias("vi"), F.expr(f32(px)).alias("x"), F.expr(f32(py)).alias("y"),
        F.expr(f32(f"least(1.0D, greatest(0.0D, {px} / canvas_width))")).alias("u"), F.expr(f32(f"least(1.0D, greatest(0.0D, {py} / canvas_height))")).alias("v"))


def grid_triangles(boxes: DataFrame) -> DataFrame:
    """Two clockwise triangles per grid cell."""
    d = mesh_density(boxes.where("width > 0 and height > 0"))
    cells = d.select(*MESH, "columns", F.explode(F.expr("sequence(0, rows * columns - 1)")).alias("cell")).withColumn(
        "tl", F.expr("(cell div columns) * (columns + 1) + cell % columns"))
    pair = ("inline(array(named_struct('ti', cell * 2, 'a', tl, 'b', tl + 1, 'c', tl + columns + 2),"
            " named_struct('ti', cell * 2 + 1, 'a', tl, 'b', tl + columns + 2, 'c', tl + columns + 1)))")
    return cells.select(*MESH, F.expr(pair))


def corners(triangles: DataFrame, vertices: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Triangles with the listed vertex fields of their three corners as structs ``pa, pb, pc`` (null if out of range)."""
    out = triangles
    for corner in "abc":
        side = vertices.select(*keys, F.col("vi").alias(corner), F.struct(*fields).alias(f"p{corner}"))
        out = out.join(side, [*keys, corner], "left")
    return out


AREA2 = "(pb.x - pa.x) * (pc.y - pa.y) - (pc.x - pa.x) * (pb.y - pa.y)"


def mesh_checks(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Problems per mesh: index range, repeated index, duplicate vertex set, degenerate or reversed winding, UV, finiteness."""
    joined = corners(triangles, vertices, MESH, ["x", "y"]).withColumn("area2", F.expr(AREA2))
    by_triangle = joined.groupBy(*MESH).agg(
        F.count("*").alias("triangles"), F.count_if(F.expr("pa is null or pb is null or pc is null")).alias("bad_index"),
        F.count_if(F.expr("a = b or b = c or a = c")).alias("repeated_index"), F.count_if(F.expr("area2 = 0")).alias("degenerate"),
        F.count_if(F.expr("area2 < 0")).alias("reversed"))
    keyed = triangles.groupBy(*MESH, F.array_sort(F.array("a", "b", "c")).alias("k")).count().where("count > 1")
    duplicates = keyed.groupBy(*MESH).agg(F.sum(F.col("count") - 1).alias("duplicates"))
    finite = lambda c: f"({c} is not null and not isnan({c}) and abs({c}) <> double('infinity'))"
    by_vertex = vertices.groupBy(*MESH).agg(
        F.count("*").alias("vertices"), F.count_if(F.expr("not (u between 0 and 1) or not (v between 0 and 1)")).alias("bad_uv"),
        F.count_if(F.expr(f"not ({' and '.join(finite(c) for c in 'xyuv')})")).alias("not_finite"))
    return by_vertex.join(by_triangle, MESH, "full").join(duplicates, MESH, "left").na.fill(0)


def resolve_parameters(registry: DataFrame) -> DataFrame:
    """Working range from the template range; the safe range is its middle 80 percent, stretched to include neutral."""
    margin = "(high - low) * (1.0D - 0.8D) / 2.0D"
    return registry.withColumn("minimum", F.col("low")).withColumn("default_value", F.col("neutral")).withColumn("maximum", F.col("high")).withColumn(
        "safe_minimum", F.expr(f"least(greatest(low + {margin}, low), neutral)")).withColumn(
        "safe_maximum", F.expr(f"greatest(least(high - {margin}, high), neutral)"))


def parameter_slots(parameter: Column) -> Column:
    """Array of the slots a parameter may move, from the fixed bridge."""
    out = F.array().cast("array<string>")
    for p, slots in fixed.PARAMETER_SLOTS.items():
        out = F.when(parameter == p, F.array(*[F.lit(s) for s in slots])).otherwise(out)
    return out


def generate_bindings(vertices: DataFrame, boxes: DataFrame, parameters: DataFrame) -> DataFrame:
    """Binding samples ``(mesh, parameter, sample_value, vi, dx, dy)`` at minimum, default and maximum.

    ``parameters`` has one row per (image, parameter); each is expanded to its slots first, so the join with meshes is an
    equi-join on (image, slot) and never an all-pairs product.
    """
    values = F.array_sort(F.array_distinct(F.array("minimum", "default_value", "maximum")))
    wanted = parameters.select("image_id", "parameter_id", "minimum", "default_value", "maximum", F.explode(parameter_slots(F.col("parameter_id"))).alias("slot_id"), values.alias("sv"))
    box = boxes.select(*MESH, F.col("x").alias("bx"), F.col("y").alias("by"), F.expr("cast(if(width = 0, 1, width) as double)").alias("w"),
                       F.expr("cast(if(height = 0, 1, height) as double)").alias("h"))
    meshes = wanted.join(box, MESH).select("*", F.posexplode("sv").alias("sample_index", "sample_value")).drop("sv")
    meshes = (meshes.withColumn("cx", F.expr("bx + w / 2.0D")).withColumn("cy", F.expr("by + h / 2.0D"))
              .withColumn("n", F.expr("sample_value / (case when greatest(abs(minimum), abs(maximum)) = 0 then 1.0D else greatest(abs(minimum), abs(maximum)) end)"))
              .withColumn("pull", F.expr("greatest(-0.92D, least(0.92D, (default_value - sample_value) / (case when maximum = minimum then 1.0D else maximum - minimum end)))")))
    joined = meshes.join(vertices.select(*MESH, "vi", "x", "y"), MESH)
    pick = lambda i: F.expr("case parameter_id " + " ".join(f"when '{p}' then {d[i]}" for p, d in fixed.DISPLACEMENTS.items()) + " else 0.0D end")
    return joined.select(*MESH, "parameter_id", "sample_index", "sample_value", "vi", pick(0).alias("dx"), pick(1).alias("dy"))


def missing_mandatory(parameters: DataFrame, bindings: DataFrame) -> DataFrame:
    """Mandatory parameters of an image without any binding."""
    bound = bindings.select("image_id", "parameter_id").distinct()
    return parameters.where("capability = 'candidate_mandatory'").select("image_id", "parameter_id").join(bound, ["image_id", "parameter_id"], "left_anti")


def sample_order_errors(samples: DataFrame, vertex_counts: DataFrame) -> DataFrame:
    """Bindings with fewer than two samples, values that do not strictly increase, or a wrong number of deltas.

    ``samples``: (binding_id, mesh_id, sample_index, sample_value, delta_count). Samples of one index follow each other by value, so the
    result does not depend on how rows arrive; a sample of a mesh that is counted twice is two samples of that index.
    """
    joined = samples.join(vertex_counts, "mesh_id", "left")
    previous = hotkeys.lag(joined, ["binding_id"], F.expr("sample_index div 1024"), ["sample_index", "sample_value"], {"before": "sample_value"})
    facts = previous.groupBy("binding_id").agg(
        F.count("*").alias("samples"), F.count_if(F.expr("sample_value <= before")).alias("not_increasing"),
        F.count_if(F.expr("not (delta_count <=> vertex_count)")).alias("wrong_count"))
    return facts.where("samples < 2 or not_increasing > 0 or wrong_count > 0")


def _ends(values: str) -> str:
    """Neighbouring levels of every wanted value, as SQL text: ``exact`` takes the upper sample, ``lo`` and ``hi`` are positions in ``levels``."""
    near = (f"transform({values}, w -> named_struct('w', w, 'below', array_max(filter(levels, s -> s < w.value)), 'above', array_min(filter(levels, s -> s >= w.value))))")
    pair = f"transform({near}, n -> named_struct('w', n.w, 'lo', coalesce(n.below, n.above), 'hi', coalesce(n.above, n.below)))"
    return (f"transform({pair}, n -> named_struct('w', n.w, 'exact', n.lo = n.hi or (n.hi = n.w.value and array_max(levels) = n.w.value), 't', (n.w.value - n.lo) / nullif(n.hi - n.lo, 0.0D),"
            " 'lo', cast(array_position(levels, n.lo) - 1 as int), 'hi', cast(array_position(levels, n.hi) - 1 as int)))")


def _aligned(levels: str, fields: tuple[str, ...]) -> str:
    """The sorted samples of a vertex in the order of ``levels``, as SQL text; a level that the vertex lacks is null."""
    same = " and ".join(f"s.{f} <=> l.{f}" for f in fields)
    key = ", ".join(f"'{f}', s.{f}" for f in fields)
    return f"if(transform(ss, s -> named_struct({key})) <=> {levels}, ss, transform({levels}, l -> get(filter(ss, s -> {same}), 0)))"


def interpolate(samples: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Piecewise-linear deltas, clamped outside the sampled range: an as-of join in both directions.

    ``samples``: (keys, sample_value, vi, dx, dy); ``values``: (keys, extra columns, value). A binding's sample values and wanted
    values are short lists (three samples; poses: two per parameter and fifteen), so neighbours are found once per binding, and a
    vertex with all its samples is shuffled once, before its values multiply it. A value at or beyond the first or last sample takes
    that sample exactly.
    """
    extra = [c for c in values.columns if c not in keys and c != "value"]
    levels = samples.where("sample_value is not null").select(*keys, "sample_value").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("sample_value")).alias("levels"))
    wanted = values.groupBy(*keys).agg(F.collect_list(F.struct(*extra, "value")).alias("ws"))
    ends = wanted.join(levels, keys).select(*keys, F.expr("transform(levels, s -> named_struct('sample_value', s))").alias("ls"), F.expr(_ends("ws")).alias("ends"))
    vertices = samples.groupBy(*keys, "vi").agg(F.sort_array(F.collect_list(F.struct("sample_value", "dx", "dy"))).alias("ss"))
    met = vertices.join(ends, keys).select(*keys, "vi", F.expr(_aligned("ls", ("sample_value",))).alias("ss"), "ends")
    each = met.select(*keys, "vi", "ss", F.explode("ends").alias("e")).where("get(ss, e.lo) is not null and get(ss, e.hi) is not null")
    pick = lambda c: F.expr(f"if(e.exact, get(ss, e.hi).{c}, get(ss, e.lo).{c} + (get(ss, e.hi).{c} - get(ss, e.lo).{c}) * e.t)").alias(c)
    return each.select(*keys, *[F.col(f"e.w.{c}").alias(c) for c in [*extra, "value"]], "vi", pick("dx"), pick("dy"))


def pose_set(parameters: DataFrame) -> DataFrame:
    """Pose values ``(image_id, pose, parameter_id, value)``: neutral, every extreme, mandatory combinations, a 12-step sweep.

    Poses of an image are listed first and joined to its parameters on the image: the output itself is poses times
    parameters (35 by 10 for the full registry).
    """
    mandatory = F.col("capability") == "candidate_mandatory"
    per_image = parameters.groupBy("image_id").agg(F.max(mandatory).alias("any_mandatory"))
    sweep = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.format_string("trajectory.%02d", i))
    combos = F.when(F.col("any_mandatory"), F.array(F.lit("combination.mandatory-min"), F.lit("combination.mandatory-max"))).otherwise(F.array().cast("array<string>"))
    shared = per_image.select("image_id", F.explode(F.concat(F.array(F.lit("neutral")), combos, sweep)).alias("pose"), F.lit(None).cast("string").alias("moved"))
    single = parameters.select("image_id", F.explode(F.array(F.lit("min"), F.lit("max"))).alias("end"), F.col("parameter_id").alias("moved")).select(
        "image_id", F.concat("moved", F.lit("."), "end").alias("pose"), "moved")
    poses = shared.unionByName(single)
    step = "cast(substring(pose, 12, 2) as int) / 11.0D"
    value = F.expr(f"""
        case when moved = parameter_id and endswith(pose, '.min') then minimum when moved = parameter_id then maximum when moved is not null then default_value
             when capability <> 'candidate_mandatory' or pose = 'neutral' then default_value when pose = 'combination.mandatory-min' then minimum
             when pose = 'combination.mandatory-max' then maximum else safe_minimum + (safe_maximum - safe_minimum) * ({step}) end""")
    return poses.join(parameters, "image_id").select("image_id", "pose", "parameter_id", value.alias("value"))


def pose_vertices(vertices: DataFrame, samples: DataFrame, poses: DataFrame) -> DataFrame:
    """Vertices of every pose: interpolated deltas added per vertex in registry order, then applied.

    A vertex has at most three samples for each of the parameters that may move its slot (nine), and a mesh one list of poses with
    the sample positions and weights of their moves. Both are shuffled before they meet; what they multiply to is not.
    """
    fields = ("rank", "parameter_id", "sample_value")
    rank = F.array_position(F.array(*[F.lit(p) for p, *_ in fixed.PARAMETERS]), F.col("parameter_id"))
    ranked = samples.where("sample_value is not null").withColumn("rank", rank)
    levels = ranked.select(*MESH, *fields).distinct().groupBy(*MESH, "rank", "parameter_id").agg(F.sort_array(F.collect_list("sample_value")).alias("levels"))
    wanted = poses.groupBy("image_id", "parameter_id").agg(F.collect_list(F.struct("pose", "value")).alias("ws"))
    bindings = levels.join(wanted, ["image_id", "parameter_id"], "left").select(*MESH, "rank", "parameter_id", "levels", F.expr(_ends("ws")).alias("ends"))
    # Levels of a mesh follow each other by rank, as the samples of its vertices do: a binding's positions start where the ones before it end.
    meshes = bindings.groupBy(*MESH).agg(F.sort_array(F.collect_list(F.struct("rank", "parameter_id", "levels"))).alias("bs"), F.collect_list(F.struct("rank", "parameter_id", "ends")).alias("es"))
    start = "aggregate(filter(bs, b -> b.rank < e.rank or (b.rank = e.rank and b.parameter_id < e.parameter_id)), 0, (n, b) -> n + size(b.levels))"
    placed = meshes.select(
        *MESH, F.expr("flatten(transform(bs, b -> transform(b.levels, s -> named_struct('rank', b.rank, 'parameter_id', b.parameter_id, 'sample_value', s))))").alias("ls"),
        F.expr(f"transform(es, e -> named_struct('rank', e.rank, 'parameter_id', e.parameter_id, 'start', {start}, 'ends', e.ends))").alias("es"))
    moves = placed.select(*MESH, "ls", F.inline("es")).select(*MESH, "ls", "rank", "parameter_id", "start", F.explode("ends").alias("e")).groupBy(*MESH, "e.w.pose").agg(
        F.first("ls").alias("ls"), F.sort_array(F.collect_list(F.struct("rank", "parameter_id", "e.exact", "e.t", F.expr("start + e.lo").alias("lo"), F.expr("start + e.hi").alias("hi")))).alias("ms"))
    # Poses that move nothing of a mesh are poses of it, too.
    every = vertices.select(*MESH).distinct().join(poses.groupBy("image_id").agg(F.collect_set("pose").alias("ps")), "image_id").select(*MESH, F.explode("ps").alias("pose"))
    listed = every.join(moves, [*MESH, "pose"], "left").groupBy(*MESH).agg(
        F.first("ls", ignorenulls=True).alias("ls"), F.collect_list(F.struct("pose", F.transform("ms", lambda m: m.dropFields("rank", "parameter_id")).alias("ms"))).alias("ps"))
    at = vertices.select(*MESH, "vi", F.struct("x", "y", "u", "v").alias("at"), F.lit(None).alias("s")).unionByName(
        ranked.select(*MESH, "vi", F.lit(None).alias("at"), F.struct(*fields, "dx", "dy").alias("s")))
    stack = at.groupBy(*MESH, "vi").agg(F.max("at").alias("at"), F.sort_array(F.collect_list("s")).alias("ss")).where("at is not null")
    met = stack.join(listed, MESH).select(*MESH, "vi", "at", F.expr(f"if(ls is null, ss, {_aligned('ls', fields)})").alias("ss"), "ps")
    posed = met.select(*MESH, "vi", "at", "ss", F.inline("ps"))
    delta = lambda c: f"coalesce(if(m.exact, get(ss, m.hi).{c}, get(ss, m.lo).{c} + (get(ss, m.hi).{c} - get(ss, m.lo).{c}) * m.t), 0.0D)"
    fold = lambda c: f"coalesce(aggregate(ms, 0.0D, (s, m) -> s + {delta(c)}), 0.0D)"
    return posed.select(*MESH, "pose", "vi", F.expr(f"at.x + {fold('dx')}").alias("x"), F.expr(f"at.y + {fold('dy')}").alias("y"), "at.u", "at.v")


# --- frame sequences ------------------------------------------------------------------------------------------------

def frame_sequence(seeds: DataFrame, domain: str) -> DataFrame:
    """37 frames per seed ``(run_id, seed)``: 12 fixed frames, then 25 on a path through five hashed waypoints.

    Everything is a narrow projection: waypoints and steps are array expressions, so nothing is shuffled.
    """
    def waypoint(ordinal: int) -> Column:
        values = []
        for parameter, low, high in fixed.SEQUENCE_PARAMETERS:
            payload = F.concat(F.encode(F.lit(domain), "utf-8"), F.unhex(F.lit("00")), digests.u64_bytes(F.col("seed")), F.unhex(F.lit(f"{ordinal:04X}00")),
                               F.encode(F.lit(parameter), "utf-8"))
            raw = digests.u64_from_hash(F.sha2(payload, 256)).cast("decimal(20,0)")
            values.append((F.lit(low) + 4 * (raw % F.lit((high - low) // 4 + 1).cast("decimal(20,0)")).cast("int")).cast("int"))
        return F.array(*values)

    neutral = F.array(*[F.lit(t) for t in fixed.MANDATORY_FRAMES[0][1]])
    points = seeds.withColumn("points", F.array(neutral, *[waypoint(i) for i in range(1, 6)], neutral))
    frames = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("frame_id"), F.lit("mandatory").alias("source"), F.array(*[F.lit(t) for t in ticks]).alias("ticks"))
                       for i, (n, ticks) in enumerate(fixed.MANDATORY_FRAMES)])
    path = F.expr("""transform(sequence(0, 24), j -> named_struct('idx', j + 12, 'frame_id', format_string('trajectory.%03d', j), 'source', 'seeded-trajectory',
        'ticks', if(j = 0, points[0], zip_with(points[(j - 1) div 4], points[(j - 1) div 4 + 1],
            (l, r) -> cast(floor((l * (4 - ((j - 1) % 4 + 1)) + r * ((j - 1) % 4 + 1)) / 4.0D) as int)))))""")
    return points.select("run_id", "seed", F.inline(F.concat(frames, path)))


# --- affine part motion ---------------------------------------------------------------------------------------------

def frame_parameters(frames: DataFrame) -> DataFrame:
    """Ticks as parameter values."""
    names = ("yaw", "pitch", "eye_left", "eye_right", "mouth")
    return frames.select("run_id", "idx", "frame_id", *[(F.col("ticks")[i] / 1000.0).alias(n) for i, n in enumerate(names)])


def part_affine(parts: DataFrame, frames: DataFrame, shift_x: float = 50.0, shift_y: float = 64.0, eye_floor: float = 0.05, mouth_gain: float = 0.5) -> DataFrame:
    """Affine ``(a, b, c, d, e, f)`` of every part in every frame of its run.

    ``parts``: (run_id, layer_id, side, motion_group, left, top, right, bottom, width, height). The head pivot is one
    aggregate per run; frames join on the run (37 rows each). Defaults are the part draft; the cut-out comparator uses
    shifts 40 and 50, eye floor 0.15 and mouth gain 0.35.
    """
    pivots = parts.where("motion_group <> 'static'").groupBy("run_id").agg(((F.min("top") + F.max("bottom")) / 2.0).alias("head_pivot"))
    j = parts.join(pivots, "run_id").join(frame_parameters(frames), "run_id")
    j = (j.withColumn("hb", F.expr("0.03D * (yaw / 15.0D)")).withColumn("hc", F.expr(f"(width / {shift_x}D) * (yaw / 15.0D) - hb * head_pivot"))
         .withColumn("hf", F.expr(f"-(height / {shift_y}D) * (pitch / 10.0D)")).withColumn("pivot", F.expr("(top + bottom) / 2.0D")))
    openness = "if(side = 'left', eye_left, eye_right)"
    scale = F.expr(f"case motion_group when 'eye' then {eye_floor}D + {1 - eye_floor}D * {openness} when 'mouth' then 1.0D + {mouth_gain}D * mouth else 1.0D end")
    j = j.withColumn("scale", scale).withColumn("shift", F.expr("(1.0D - scale) * pivot"))
    static = F.col("motion_group") == "static"
    value = lambda moving, still: F.when(static, F.lit(still)).otherwise(F.expr(moving))
    return j.select(
        "run_id", "layer_id", "motion_group", "idx", "left", "top", "right", "bottom", F.lit(1.0).alias("a"), value("hb * scale", 0.0).alias("b"),
        value("hb * shift + hc", 0.0).alias("c"), F.lit(0.0).alias("d"), value("scale", 1.0).alias("e"), value("shift + hf", 0.0).alias("f"))


def foldover_check(affines: DataFrame) -> DataFrame:
    """Per run: samples, folded samples and the smallest signed area (twice) of every mapped part box."""
    corner = [("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom")]
    x = [f"(a * {px} + b * {py} + c)" for px, py in corner]
    y = [f"(d * {px} + e * {py} + f)" for px, py in corner]
    area = " + ".join(f"({x[i]} * {y[(i + 1) % 4]} - {x[(i + 1) % 4]} * {y[i]})" for i in range(4))
    measured = affines.withColumn("area2", F.expr(area))
    return measured.groupBy("run_id").agg(
        F.count("*").alias("samples"), F.count_if(F.col("area2") <= 0).alias("folded"), F.min("area2").alias("minimum_area2"))


def neutral_frames_agree(frames: DataFrame) -> DataFrame:
    """Runs and whether all frames with neutral parameters share one digest; two combinable aggregates, no distinct count."""
    neutral = frames.where("is_neutral").groupBy("run_id").agg(F.count("*").alias("frames"), F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    return neutral.select("run_id", "frames", (F.col("lo") == F.col("hi")).alias("agree"))


# --- raster warping -------------------------------------------------------------------------------------------------

#: What a triangle gives to all of its samples.
CARRIED = ("image_id", "slot_id", "pose", "ti", "draw_order", "opacity", "width", "height")
CELLS = 1 << 20


def sample_schema(boxes: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    return ", ".join([f"{c} {kinds[c]}" for c in CARRIED] + ["px int", "py int", "x0 int", "y0 int", "fx double", "fy double"])


def _floors(values: np.ndarray) -> np.ndarray:
    whole = np.nan_to_num(np.floor(values), nan=0.0, posinf=np.inf, neginf=-np.inf)
    if len(whole) and np.abs(whole).max() > 2**31 - 1:
        raise OverflowError("a texture coordinate is beyond 32 bits")
    return whole


def _samples_of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pixels of every triangle's box whose centre lies in the triangle, with the texel corner and fractions they map to.

    Arrays of at most ``CELLS`` pixels (or one triangle) at once. The arithmetic is that of SQL, operation by operation; as there, a
    NaN is larger than any number, and its floor is 0.
    """
    at_least = lambda w: (w >= 0) | np.isnan(w)
    for batch in batches:
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names if name not in CARRIED or name in ("width", "height")}
        wide = columns["high_x"].astype(np.int64) - columns["low_x"] + 1
        cells = wide * (columns["high_y"].astype(np.int64) - columns["low_y"] + 1)
        ends, first = np.cumsum(cells), 0
        while first < len(cells):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - cells[first] + CELLS, "right")))
            own = np.repeat(np.arange(first, last), cells[first:last])
            place = np.arange(len(own)) - np.repeat(ends[first:last] - cells[first:last] - (ends[first] - cells[first]), cells[first:last])
            px, py = columns["low_x"][own] + place % wide[own], columns["low_y"][own] + place // wide[own]
            ax, ay, bx, by, cx, cy = (columns[p + c][own] for p in "abc" for c in "xy")
            sx, sy, den = px + 0.5, py + 0.5, columns["den"][own]
            with np.errstate(all="ignore"):
                w0 = ((bx - sx) * (cy - sy) - (cx - sx) * (by - sy)) / den
                w1 = ((cx - sx) * (ay - sy) - (ax - sx) * (cy - sy)) / den
                w2 = 1.0 - w0 - w1
                inside = at_least(w0) & at_least(w1) & at_least(w2)
                own, px, py, w0, w1, w2 = (v[inside] for v in (own, px, py, w0, w1, w2))
                tx = (w0 * columns["au"][own] + w1 * columns["bu"][own] + w2 * columns["cu"][own]) * columns["width"][own] - 0.5
                ty = (w0 * columns["av"][own] + w1 * columns["bv"][own] + w2 * columns["cv"][own]) * columns["height"][own] - 0.5
            x0, y0, at = _floors(tx), _floors(ty), pa.array(own)
            found = [px.astype(np.int32), py.astype(np.int32), x0.astype(np.int32), y0.astype(np.int32), tx - x0, ty - y0]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in CARRIED] + [pa.array(v) for v in found], [*CARRIED, "px", "py", "x0", "y0", "fx", "fy"])
            first = last


def warp_rasters(vertices: DataFrame, triangles: DataFrame, textures: DataFrame, layers: DataFrame) -> DataFrame:
    """Render posed layers: inverse barycentric mapping, premultiplied bilinear taps, opacity, ordered source-over.

    ``vertices``: (image_id, slot_id, pose, vi, x, y, u, v); ``textures``: (image_id, slot_id, x, y, r, g, b, a);
    ``layers``: (image_id, slot_id, draw_order, opacity, width, height). Every triangle expands to the pixels of its own
    box clipped to the canvas, in an Arrow function over arrays of pixels, so work follows the covered area; samples meet their four texels by an equi-join on the corner.
    """
    keys = ["image_id", "slot_id", "pose"]
    posed = triangles.join(vertices.select(*keys).distinct(), MESH)
    tri = corners(posed, vertices, keys, ["x", "y", "u", "v"]).join(layers.where("opacity > 0"), MESH)
    # Triangles are small and become many pixels: they are dealt out first, or a few tasks would hold all of them.
    tri = tri.withColumn("den", F.expr(AREA2)).where("den <> 0").select(
        *keys, "ti", "draw_order", "opacity", "width", "height", "den", *[F.col(f"p{p}.{c}").alias(f"{p}{c}") for p in "abc" for c in "xyuv"]).repartition(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "ti")
    low = lambda c: f"greatest(0, cast(floor(least(a{c}, b{c}, c{c})) as int))"
    high = lambda c, side: f"least({side} - 1, cast(floor(greatest(a{c}, b{c}, c{c})) as int) + 1)"
    known = " and ".join(f"{p}{c} is not null" for p in "abc" for c in "uv")
    boxes = tri.withColumns({f"low_{c}": F.expr(low(c)) for c in "xy"} | {f"high_{c}": F.expr(high(c, side)) for c, side in (("x", "width"), ("y", "height"))})
    boxes = boxes.where(f"low_y <= high_y and low_x <= high_x and {known}")
    sample = boxes.mapInArrow(_samples_of_triangles, sample_schema(boxes))
    # The four taps of a sample are the texels around its corner (x0, y0), clamped to the canvas; they are gathered once per texture,
    # so that a sample of any pose meets them in one row.
    span = lambda c: f"sequence({c} - 1, {c})"
    texels = textures.where("a > 0").join(layers.select(*MESH, "width", "height").distinct(), MESH).select(
        *MESH, F.expr("cast(x as int)").alias("x"), F.expr("cast(y as int)").alias("y"), "width", "height", F.expr("((cast(r as bigint) * 256 + g) * 256 + b) * 256 + a").alias("rgba"))
    reached = texels.where("x between 0 and width - 1 and y between 0 and height - 1").select("*", F.explode(F.expr(span("x"))).alias("x0")).select(
        "*", F.explode(F.expr(span("y"))).alias("y0"))
    hit = lambda t: F.expr(f"x = least(greatest(x0 + {t % 2}, 0), width - 1) and y = least(greatest(y0 + {t // 2}, 0), height - 1)")
    quads = reached.groupBy(*MESH, "width", "height", "x0", "y0").agg(*[F.max(F.when(hit(t), F.col("rgba"))).alias(f"q{t}") for t in range(4)])
    clamped = lambda c, side: F.expr(f"least(greatest({c}, -1), {side} - 1)").alias(c)
    corner = [*MESH, "width", "height", "x0", "y0"]
    four = sample.select(*keys, "ti", "px", "py", "draw_order", "opacity", "width", "height", "fx", "fy", clamped("x0", "width"), clamped("y0", "height")).join(quads, corner)
    weights = ["(1.0D - fx) * (1.0D - fy)", "fx * (1.0D - fy)", "(1.0D - fx) * fy", "fx * fy"]
    alpha = [f"coalesce((q{i} & 255) / 255.0D, 0.0D)" for i in range(4)]
    total_a = " + ".join(f"{alpha[i]} * ({weights[i]})" for i in range(4))
    total = lambda bits: " + ".join(f"coalesce(shiftright(q{i}, {bits}) & 255, 0) * {alpha[i]} * ({weights[i]})" for i in range(4))
    shade = lambda bits: F.expr(f"cast(least(255.0D, greatest(0.0D, bround(({total(bits)}) / ta))) as bigint)")
    lit = four.withColumn("ta", F.expr(total_a)).where("ta > 0")
    coloured = lit.select(*keys, F.col("px").alias("x"), F.col("py").alias("y"), "draw_order", F.col("ti").alias("layer_rank"), shade(24).alias("r"), shade(16).alias("g"), shade(8).alias("b"),
                          F.expr("cast(least(255.0D, greatest(0.0D, bround(ta * 255.0D))) as bigint)").alias("a"), "opacity")
    faded = coloured.withColumn("a", F.expr("if(opacity < 1.0D, cast(bround(a * opacity) as bigint), a)")).where("a > 0")
    packed = faded.select(F.struct("image_id", "pose").alias("image_id"), "x", "y", "draw_order", "layer_rank", "r", "g", "b", "a")
    return composite_over(packed).select("image_id.image_id", "image_id.pose", "x", "y", "r", "g", "b", "a")


def pose_coverage(rendered: DataFrame, poses: DataFrame, vertices: DataFrame, threshold: int = 31, limit: float = 1e6) -> DataFrame:
    """Visible pixels of every pose against neutral: none blocks, under a quarter reviews, a coordinate off range blocks."""
    counts = rendered.where(F.col("a") > threshold).groupBy("image_id", "pose").agg(F.count("*").alias("visible"))
    wild = vertices.groupBy("image_id", "pose").agg(F.count_if(F.expr(f"not (x > -{limit} and x < {limit} and y > -{limit} and y < {limit})")).alias("off_range"))
    every = poses.select("image_id", "pose").distinct().join(counts, ["image_id", "pose"], "left").join(wild, ["image_id", "pose"], "left").na.fill(0)
    neutral = every.where("pose = 'neutral'").select("image_id", F.col("visible").alias("neutral_visible"))
    status = F.expr("case when visible = 0 or off_range > 0 then 'blocking' when neutral_visible > 0 and visible < neutral_visible * 0.25D then 'review' else 'ok' end")
    return every.join(neutral, "image_id", "left").withColumn("status", status)
