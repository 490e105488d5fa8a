"""Layer proposal from layout priors, ontology completion, and bounded completion of hidden regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .pixels import PX, box_aggregates

LX = ["image_id", "slot_id", "x", "y"]


def layout_regions(bounds: DataFrame) -> DataFrame:
    """Eleven slot boxes from each subject box ``(x, y, width, height)``; a narrow projection with half-even rounding."""
    df = bounds.where("width > 0 and height > 0")
    for name, text in fixed.LAYOUT_MEASURES:
        df = df.withColumn(name, F.expr(text))
    whole = lambda t: f"cast(bround({t}) as int)"
    rows = ", ".join(
        f"named_struct('slot_id', '{s}', 'side', '{side}', 'x', {whole(x)}, 'y', {whole(y)}, 'width', greatest(1, {whole(w)}), 'height', greatest(1, {whole(h)}))"
        for s, side, x, y, w, h in fixed.LAYOUT_BOXES)
    return df.select("image_id", F.expr(f"inline(array({rows}))"))


def _fixed_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def decide_layers(proposals: DataFrame, slots: DataFrame, producer_kind: str = "deterministic", namespace: str = "") -> DataFrame:
    """Attach draw order, name and status to non-empty proposals ``(image_id, slot_id, side, coverage, box...)``.

    Slots come from the ontology registry (a fixed number of rows, hence the broadcast). Slot ids of proposals and registry carry the
    ``namespace``; layer ids and fixed orders do not. An id without it is an unknown slot.
    """
    registry = F.broadcast(slots.select("slot_id", F.col("side").alias("expected_side")))
    copies = proposals.groupBy("image_id", "slot_id").agg(F.count("*").alias("copies"))
    joined = proposals.join(registry, "slot_id", "left").join(copies, ["image_id", "slot_id"])
    bare = F.when(F.startswith("slot_id", F.lit(namespace)), F.substring("slot_id", len(namespace) + 1, 1 << 20)) if namespace else F.col("slot_id")
    order = _fixed_map(fixed.DRAW_ORDER)[bare]
    known = F.coalesce(F.array_contains(F.array(*[F.lit(s) for s, *_ in fixed.SLOTS]), bare), F.lit(False))
    problem = F.when(~known, "UNKNOWN_SLOT").when(F.expr("expected_side is not null and side <> expected_side"), "SIDE_CONFLICT").when(
        F.col("copies") > 1, "DUPLICATE_SLOT")
    layer_id = F.concat(F.lit("layer."), F.regexp_replace(F.coalesce(bare, "slot_id"), r"\.", "-"))
    status = "PRESENT" if producer_kind == "model_backed" else "LOW_CONFIDENCE"
    return joined.where("coverage > 0 or copies > 1").select(
        "image_id", "slot_id", "side", layer_id.alias("layer_id"), _fixed_map(fixed.DISPLAY_NAMES)[bare].alias("display_name"),
        order.alias("draw_order"), F.lit(status).alias("status"), problem.alias("problem"))


def ontology_completion(images: DataFrame, layers: DataFrame, namespace: str = "") -> DataFrame:
    """One row per (image, slot) always: the layer's status, LOW_CONFIDENCE for a missing required slot, else NOT_APPLICABLE.

    An image has at most one decided layer per slot, so a minimum stands for the instance.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("slot_index"), F.lit(namespace + s).alias("slot_id"), F.lit(a).alias("applicability"))
                     for i, (s, _, _, _, a) in enumerate(fixed.SLOTS)])
    expected = images.select("image_id", F.inline(rows))
    present = layers.groupBy("image_id", "slot_id").agg(F.min("layer_id").alias("instance_id"), F.min("status").alias("layer_status"))
    status = F.expr("case when instance_id is not null then layer_status when applicability = 'required' then 'LOW_CONFIDENCE' else 'NOT_APPLICABLE' end")
    joined = expected.join(present, ["image_id", "slot_id"], "left").withColumn("status", status)
    return joined.withColumn("reason_code", F.when(F.col("status") == "LOW_CONFIDENCE", "ONTOLOGY_SLOT_LOW_CONFIDENCE")).drop("layer_status")


def percent_patches(images: DataFrame) -> DataFrame:
    """Cut-out boxes at fixed percentages: floor the minimum, ceil the maximum, clip; empty ones are dropped."""
    rows = ", ".join(
        f"named_struct('patch_id', '{p}', 'parameter_id', {'null' if q is None else repr(q)}, 'side', '{side}', 'left', greatest(0L, {x0} * width div 100),"
        f" 'top', greatest(0L, {y0} * height div 100), 'right', least(width, ({x1} * width + 99) div 100), 'bottom', least(height, ({y1} * height + 99) div 100))"
        for p, q, side, (x0, y0, x1, y1) in fixed.PATCHES)
    sized = images.select("image_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))
    return sized.select("image_id", F.expr(f"inline(array({rows}))")).where("left < right and top < bottom")


def part_boxes(parts: DataFrame, images: DataFrame, threshold: int = 15, padding: int = 4) -> DataFrame:
    """Padded boxes of visible parts ``(pixel, part, a)``; the eye is split at mid canvas (character left is screen right)."""
    dims = images.select("image_id", "width", "height")
    seen = parts.where(F.col("a") > threshold).join(dims, "image_id")
    side = F.expr("case when part <> 'eye' then 'not-applicable' when x >= width div 2 then 'left' else 'right' end")
    sided = seen.withColumn("side", side)
    boxes = sided.groupBy("image_id", "part", "side", "width", "height").agg(
        F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"))
    lo = F.expr("case when part = 'eye' and side = 'left' then width div 2 else 0 end")
    hi = F.expr("case when part = 'eye' and side = 'right' then width div 2 else width end")
    static = F.col("part").isin(*fixed.STATIC_PARTS)
    group = F.when(F.col("part") == "eye", "eye").when(static, "static").when(F.col("part") == "mouth", "mouth").otherwise("head")
    layer_id = F.concat(F.lit("layer."), F.regexp_replace("part", " ", "-"), F.when(F.col("part") == "eye", F.concat(F.lit(".character-"), "side")).otherwise(""))
    return boxes.select(
        "image_id", layer_id.alias("layer_id"), "part", "side", F.greatest(lo, F.col("l") - padding).alias("left"),
        F.greatest(F.lit(0), F.col("t") - padding).alias("top"), F.least(hi, F.col("r") + padding).alias("right"),
        F.least(F.col("height"), F.col("b") + padding).alias("bottom"), group.alias("motion_group"))


def corner_fill(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Paint each image's head box with the floored mean of its four corner pixels, and cut the head layer's child boxes.

    Corners are picked while aggregating; boxes are arithmetic on the declared geometry, so no range join is needed.
    """
    dims = images.select("image_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))
    sized = pixels.join(dims, "image_id")
    corner = F.expr("(x = 0 or x = width - 1) and (y = 0 or y = height - 1)")
    means = sized.where(corner).groupBy("image_id").agg(*[F.expr(f"sum({c} * (if(width = 1, 2, 1) * if(height = 1, 2, 1))) div 4").alias(f"m{c}") for c in "rgba"])

    def inside(box: tuple[int, int, int, int]) -> str:
        x0, y0, x1, y1 = box
        return (f"(x >= {x0} * width div 100 and x < ({x1} * width + 99) div 100 and y >= {y0} * height div 100 and y < ({y1} * height + 99) div 100)")

    head, *children = [inside(box) for *_, box in fixed.PATCHES]
    painted = sized.join(means, "image_id")
    base = [F.expr(f"if({head}, m{c}, {c})").alias(c) for c in "rgba"]
    cut = F.expr(f"{head} and ({' or '.join(children)})")
    return painted.select(*PX, *base, F.expr(head).alias("in_head"), cut.alias("cut_from_head"))


def head_opaque_gate(pixels: DataFrame, images: DataFrame, min_side: int = 64) -> DataFrame:
    """Verdict per image: large enough, and every head-box pixel fully opaque."""
    x0, y0, x1, y1 = fixed.PATCHES[0][3]
    head = F.expr(f"x >= {x0} * width div 100 and x < ({x1} * width + 99) div 100 and y >= {y0} * height div 100 and y < ({y1} * height + 99) div 100")
    sized = pixels.join(images.select("image_id", "width", "height"), "image_id")
    facts = sized.groupBy("image_id", "width", "height").agg(F.min(F.when(head, F.col("a"))).alias("lowest"), F.max(F.when(head, F.col("a"))).alias("highest"))
    reason = F.expr(f"case when width < {min_side} or height < {min_side} then 'RASTER_DIMENSIONS_UNSUPPORTED'"
                    " when not (lowest <=> 255 and highest <=> 255) then 'CANDIDATE_SUITABILITY_UNSUPPORTED' else 'SUPPORTED' end")
    return facts.select("image_id", "lowest", "highest", reason.alias("verdict"))


def motion_lineage(parts: DataFrame) -> DataFrame:
    """Operations applied to each motion layer and the bindings whose targets contain it."""
    operations = F.array_compact(F.array(
        F.lit("alpha-clean"), F.lit("subject-matte"), F.lit("bbox-crop-padding-4"), F.when(F.col("part") == "face", "deterministic-face-underpaint"),
        F.when(F.col("part").isin(*fixed.FEATURE_PARTS), "source-visible-feature-rgb"), F.when(F.col("part") == "eye", "grouped-eye-mask")))

    def applies(group: str | None, side: str | None) -> Column:
        moving = F.col("motion_group") != "static" if group is None else F.col("motion_group") == group
        return moving if side is None else moving & (F.col("side") == side)

    bindings = F.array_compact(F.array(*[F.when(applies(g, s), b) for b, _, g, s in fixed.PART_BINDINGS]))
    return parts.select("image_id", "layer_id", "part", "side", operations.alias("operations"), bindings.alias("binding_ids"))


# --- bounded completion -------------------------------------------------------------------------------------------

def reveal_margin(slot: Column) -> Column:
    return F.coalesce(_fixed_map(fixed.REVEAL_MARGINS)[slot], F.lit(fixed.DEFAULT_REVEAL_MARGIN))


def pixel_words(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, word, bits): the pixels of a raster line, 64 to a number; bit i of word w is x = 64 * w + i."""
    return pixels.groupBy(*keys, F.col("y").cast("int").alias("y"), F.expr("cast(x div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("bits"))


def _smeared(bits: str, shift: str, steps: list[str]) -> str:
    """``bits`` or-ed with itself moved by up to the sum of ``steps``, none of which leaves a gap behind the steps before it."""
    for step in steps:
        bits = f"transform(array({bits}), b -> b | {shift}(b, {step}))[0]"
    return bits


def grown_words(masks: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, slot_id, y, word, seen, near, within): visible bits and bits within each layer's reveal margin of them, on the canvas.

    A word grows along its line by shifts, over into the words beside it, and then down and up by its margin. ``within`` are the
    bits of the canvas.
    """
    margins = [*fixed.REVEAL_MARGINS.values(), fixed.DEFAULT_REVEAL_MARGIN]
    if max(margins) > 63 or min(margins) < 1:
        raise ValueError("a reveal margin reaches beyond the neighbouring word")
    seen = masks.where("v > 0 and x >= 0 and y >= 0")
    sized = pixel_words(seen, ["image_id", "slot_id"]).join(images.select("image_id", "width", "height"), "image_id")
    within = "if((word + 1) * 64 <= width, -1L, shiftleft(1L, greatest(0, cast(width - word * 64 as int))) - 1L)"
    clipped = sized.where("y < height and word * 64 < width").withColumn("bits", F.expr(f"bits & {within}")).where("bits <> 0")
    wide = clipped.withColumn("margin", reveal_margin(F.col("slot_id")))
    steps = [f"least(greatest(margin - {2 ** i - 1}, 0), {2 ** i})" for i in range(6)]
    whole = [str(2 ** i) for i in range(6)]
    reach = [
        (0, f"{_smeared('bits', 'shiftleft', steps)} | {_smeared('bits', 'shiftrightunsigned', steps)}"),
        (1, _smeared("shiftrightunsigned(bits, 64 - margin)", "shiftrightunsigned", whole)),
        (-1, _smeared("shiftleft(bits, 64 - margin)", "shiftleft", whole)),
    ]
    beside = F.expr("inline(array(" + ", ".join(f"named_struct('side', {side}, 'near', {bits})" for side, bits in reach) + "))")
    lines = wide.select("image_id", "slot_id", "y", "word", "bits", "margin", "width", "height", beside).where(
        "near <> 0 and word + side >= 0 and (word + side) * 64 < width")
    rows = lines.select("image_id", "slot_id", "y", (F.col("word") + F.col("side")).alias("word"), "width", "near", F.expr("if(side = 0, bits, 0L)").alias("bits"), F.explode(F.expr(
        "sequence(cast(greatest(0, y - margin) as int), cast(least(height - 1, y + margin) as int))")).alias("cy"))
    placed = rows.select("image_id", "slot_id", F.col("cy").alias("y"), "word", "width", "near", F.expr("if(cy = y, bits, 0L)").alias("seen"))
    grown = placed.groupBy("image_id", "slot_id", "y", "word", "width").agg(F.bit_or("seen").alias("seen"), F.bit_or("near").alias("near"))
    return grown.select("image_id", "slot_id", "y", "word", "seen", F.expr(f"near & {within}").alias("near"))


def dilate_binary(grid: DataFrame, keys: list[str], hit: str, radius: Column, out: str) -> DataFrame:
    """Square dilation of a 0/1 column by a per-group radius.

    The nearest set cell to each side is found with running windows along one raster line, so the cost does not depend
    on the radius. Lines are bounded by the canvas side.
    """
    df = grid.withColumn("__r", radius)
    for axis, across, source in (("x", "y", F.col(hit) > 0), ("y", "x", F.col("__near"))):
        line = Window.partitionBy(*keys, across).orderBy(axis)
        position = F.when(source, F.col(axis))
        before = F.max(position).over(line.rowsBetween(Window.unboundedPreceding, 0))
        after = F.min(position).over(line.rowsBetween(0, Window.unboundedFollowing))
        df = df.withColumn("__b", before).withColumn("__a", after)
        df = df.withColumn("__near", F.coalesce(F.col(axis) - F.col("__b") <= F.col("__r"), F.lit(False)) | F.coalesce(F.col("__a") - F.col(axis) <= F.col("__r"), F.lit(False)))
    return df.withColumn(out, F.col("__near")).drop("__r", "__b", "__a", "__near")


def reveal_target(masks: DataFrame, subject: DataFrame, images: DataFrame) -> DataFrame:
    """Per layer pixel: visible, or a target that motion may reveal.

    Target = within the margin of the visible mask, inside the subject, not visible, and covered by some layer in front
    (the front-most draw order at the pixel is above the layer's own). ``masks``: (image_id, slot_id, draw_order, x, y, v).
    """
    line = ["image_id", "y", "word"]
    masks = masks.where("v > 0 and x >= 0 and y >= 0")
    # at most one entry for every draw order, and for every value of the subject in 64 pixels
    stacks = pixel_words(masks, ["image_id", "draw_order"]).groupBy(*line).agg(F.collect_list(F.struct("draw_order", "bits")).alias("stack"))
    inside = subject.where("v > 0 and x >= 0 and y >= 0").select(*PX, F.least(F.lit(255), "v").alias("v"))
    values = pixel_words(inside, ["image_id", "v"]).groupBy(*line).agg(F.collect_list(F.struct("v", "bits")).alias("values"))
    joined = grown_words(masks, images).join(values, line, "left").join(stacks, line, "left")
    own = _fixed_map(fixed.DRAW_ORDER)[F.col("slot_id")]
    front = F.expr("aggregate(filter(stack, s -> s.draw_order > own_order), 0L, (b, s) -> b | s.bits)")
    hidden = joined.withColumn("own_order", own).withColumn("front", front).withColumn("hidden", F.expr("near & front & ~seen"))
    entries = F.expr("""inline(concat(array(named_struct('visible', 1, 'target', cast(0 as int), 'bits', seen)),
      coalesce(transform(values, s -> named_struct('visible', 0, 'target', cast(s.v as int), 'bits', s.bits & hidden)), array())))""")
    cells = hidden.select("image_id", "slot_id", "y", "word", entries).where("bits <> 0").select("*", F.explode(F.expr(
        "filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1) = 1)")).alias("i"))
    return cells.select("image_id", "slot_id", F.expr("word * 64 + i").alias("x"), "y", "visible", "target")


def soften_generated(reveal: DataFrame, images: DataFrame, radius: int = 3) -> DataFrame:
    """Box-feather each layer's target, clip it to the target, and keep full coverage where the layer is visible.

    Window sums run over the layer's own cells plus a halo of ``radius``; the divisor is the clamped sample count, which
    is arithmetic on the coordinates, so zero cells outside the target never have to exist.
    """
    keys = ["image_id", "slot_id"]
    dims = images.select("image_id", "width", "height")
    targets = reveal.where("target > 0")
    # a vertical pass needs the horizontal sums of every column the target touches, on the target's own rows
    halo = targets.select(*keys, "y", "x", "target", F.explode(F.expr(f"sequence(x - {radius}, x + {radius})")).alias("cx"))
    horizontal = halo.groupBy(*keys, F.col("cx").alias("x"), "y").agg(F.sum("target").alias("s"))
    horizontal = horizontal.join(dims, "image_id").where("x >= 0 and x < width").withColumn(
        "h", F.expr(f"s div (least(width - 1, x + {radius}) - greatest(0, x - {radius}) + 1)"))
    spread = horizontal.select(*keys, "x", "height", "h", F.explode(F.expr(f"sequence(y - {radius}, y + {radius})")).alias("y"))
    vertical = spread.where("y >= 0 and y < height").groupBy(*keys, "x", "y", "height").agg(F.sum("h").alias("s"))
    soft = vertical.withColumn("f", F.expr(f"s div (least(height - 1, y + {radius}) - greatest(0, y - {radius}) + 1)")).select(*LX, "f")
    joined = reveal.join(soft, LX, "left")
    generated = F.expr("if(visible = 1, 0, least(target, coalesce(f, 0)))")
    return joined.select(*LX, "visible", "target", generated.alias("generated"), F.expr("if(visible = 1, 255, least(target, coalesce(f, 0)))").alias("coverage"))


def soften_texture(filled: DataFrame, source: DataFrame, softened: DataFrame) -> DataFrame:
    """Layer textures: filled colours scaled by coverage, exact source values restored where the layer is visible.

    A target cell that no fill reaches keeps the source colour and alpha under its coverage.
    """
    src = source.select(*PX, *[F.col(c).alias(f"s{c}") for c in "rgba"])
    joined = softened.join(filled.select(*LX, "r", "g", "b", "a"), LX, "left").join(src, PX, "left")
    for c in "rgb":
        joined = joined.withColumn(c, F.expr(f"if(visible = 1, s{c}, coalesce({c}, s{c}, 0))"))
    alpha = F.expr("if(visible = 1, sa, (coalesce(a, sa, 0) * coverage + 127) div 255)")
    return joined.withColumn("a", alpha).select(*LX, "r", "g", "b", "a")


def generated_regions(softened: DataFrame, seed: Column, config_digest: str) -> DataFrame:
    """Provenance rows of the completion regions: reveal box, generated samples, producer, seed and config digest."""
    facts = softened.groupBy("image_id", "slot_id").agg(
        F.max("target").alias("most"), F.count_if(F.col("generated") > 0).alias("samples"), *box_aggregates(F.expr("visible = 1 or target > 0")))
    layer = F.regexp_replace("slot_id", r"\.", "-")
    return facts.where("most > 0").select(
        "image_id", F.concat(F.lit("generated."), layer).alias("region_id"), F.concat(F.lit("layer."), layer).alias("owner_layer_id"),
        "x", "y", "width", "height", "samples", F.lit("edge-extension").alias("producer"), seed.alias("seed"), F.lit(config_digest).alias("config_digest"))
