"""Layer compositing and per-pixel winners.

Source-over in 8-bit fixed point is not associative, so a pixel's layers are folded in draw order, and layers of one draw
order all paint, in the order of ``layer_rank``. A pixel group is never longer than the stack of layers that cover the pixel
(about one per ontology slot or model part).
Everything that only needs the front-most or the strongest layer is a plain combinable aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import cut
from . import hotkeys
from .pixels import PX

RGBA = "((cast(r as bigint) * 256 + g) * 256 + b) * 256 + a"


def composite_over(layers: DataFrame) -> DataFrame:
    """Straight-alpha source-over of all layers in ascending draw order; pixels without coverage have no row.

    Layers of equal draw order paint in ascending ``layer_rank`` where the input has that column, else by packed colour.
    """
    if "layer_rank" in layers.columns:
        ranked = layers.where("a > 0").groupBy(*PX).agg(F.sort_array(F.collect_list(F.struct("draw_order", "layer_rank", F.expr(RGBA).alias("rgba")))).alias("s"))
        stacks = ranked.select(*PX, F.transform("s", lambda e: e["rgba"]).alias("stack"))
    else:
        packed = layers.where("a > 0").select(*PX, F.expr(f"draw_order * 4294967296L + {RGBA}").alias("entry"))
        stacks = packed.groupBy(*PX).agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    channel = lambda e, bits: f"(shiftright({e}, {bits}) & 255)"
    sa, under = "(t & 255)", "(s.a * (255 - (t & 255)))"
    out_a = f"({sa} + ({under} + 127) div 255)"
    mixed = ", ".join(
        f"'{c}', least(255L, ({channel('t', bits)} * {sa} * 255 + s.{c} * {under}) div ({out_a} * 255))" for c, bits in (("r", 24), ("g", 16), ("b", 8)))
    plain = ", ".join(f"'{c}', {channel('t', bits)}" for c, bits in (("r", 24), ("g", 16), ("b", 8)))
    fold = (f"aggregate(stack, named_struct('r', 0L, 'g', 0L, 'b', 0L, 'a', 0L), (s, t) ->"
            f" if({sa} = 255, named_struct({plain}, 'a', 255L), named_struct({mixed}, 'a', {out_a})))")
    return stacks.select(*PX, F.expr(fold).alias("c")).select(*PX, "c.r", "c.g", "c.b", "c.a")


def front_orders(layers: DataFrame, threshold: int) -> DataFrame:
    """Draw order of the front-most layer with alpha above the threshold at each pixel."""
    return layers.where(F.col("a") > threshold).groupBy(*PX).agg(F.max("draw_order").alias("front_order"))


def occluder_union(layers: DataFrame, targets: DataFrame, threshold: int = 0) -> DataFrame:
    """255 where any layer in front of the target's draw order is present, for every target (pixel, draw order).

    "Something is in front" is the same as "the front-most layer is in front", so no per-layer mask is accumulated.
    """
    front = front_orders(layers, threshold)
    value = F.when(F.col("front_order") > F.col("draw_order"), 255).otherwise(0)
    return targets.join(front, PX, "left").select(*[targets[c] for c in targets.columns], value.alias("v"))


def source_protection(layers: DataFrame, source: DataFrame, threshold: int = 31) -> DataFrame:
    """Per image: visible source pixels, pixels whose neutral composite deviates, and the worst channel delta."""
    composite = composite_over(layers).select(*PX, *[F.col(c).alias(f"c{c}") for c in "rgb"])
    joined = source.where(F.col("a") > threshold).join(composite, PX, "left")
    delta = F.greatest(*[F.abs(F.col(c) - F.coalesce(F.col(f"c{c}"), F.lit(0))) for c in "rgb"])
    return joined.withColumn("delta", delta).groupBy("image_id").agg(
        F.count("*").alias("visible"), F.count_if(F.col("delta") > 0).alias("deviating"), F.max("delta").alias("worst"))


def generated_exposure(generated: DataFrame, layers: DataFrame, source: DataFrame, threshold: int = 31) -> DataFrame:
    """Generated samples ``(pixel, owner_order, v)`` that show at neutral over visible source: nothing in front covers them."""
    front = front_orders(layers, threshold)
    visible = source.where(F.col("a") > threshold).select(*PX)
    exposed = generated.where("v > 0").join(visible, PX).join(front, PX, "left").where("front_order is null or front_order <= owner_order")
    return exposed.groupBy("image_id", "owner_order").agg(F.count("*").alias("exposed"))


def front_winner(parts: DataFrame, threshold: int = 0) -> DataFrame:
    """Winning part per pixel: least depth, ties to the higher priority; both packed into one integer minimum."""
    best = parts.where(F.col("a") > threshold).groupBy(*PX).agg(F.min(F.expr("depth * 64 + (63 - priority)")).alias("w"))
    return best.select(*PX, F.expr("63 - w % 64").alias("winner"), F.expr("w div 64").alias("winner_depth"))


def preserve_source(parts: DataFrame, source: DataFrame, threshold: int = 31) -> DataFrame:
    """Copy source colours into the winning part wherever the source is visible."""
    seen = source.where(F.col("a") > threshold).select(*PX, F.struct("r", "g", "b").alias("s"))
    joined = parts.join(front_winner(parts), PX, "left").join(seen, PX, "left")
    take = F.expr("priority <=> winner and s is not null")
    for c in "rgb":
        joined = joined.withColumn(c, F.when(take, F.col(f"s.{c}")).otherwise(F.col(c)))
    return joined.drop("winner", "winner_depth", "s")


def union_alpha(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*PX).agg(F.max("a").alias("union_a"))


def reconstruct(parts: DataFrame, source: DataFrame) -> DataFrame:
    """Source colours with the union alpha; colour is zero where no part covers the pixel."""
    joined = source.join(union_alpha(parts), PX, "left").withColumn("u", F.coalesce("union_a", F.lit(0)))
    colours = [F.when(F.col("u") > 0, F.col(c)).otherwise(0).alias(c) for c in "rgb"]
    return joined.select(*PX, *colours, F.col("u").alias("a"))


def hidden_masks(parts: DataFrame) -> DataFrame:
    """Samples of parts that are present at a pixel without winning it."""
    return parts.where("a > 0").join(front_winner(parts), PX).where("priority <> winner").select(*PX, "part", "priority")


def source_partition(parts: DataFrame, source: DataFrame, threshold: int = 31) -> DataFrame:
    """Classify pixels as protected (both), exposed (parts only) or omission (source only)."""
    union = parts.where("a > 0").select(*PX).distinct().withColumn("u", F.lit(True))
    visible = source.where(F.col("a") > threshold).select(*PX).withColumn("s", F.lit(True))
    region = F.expr("case when u and s then 'protected' when u then 'exposed' else 'omission' end")
    return union.join(visible, PX, "full").select(*PX, region.alias("region"))


def partition_check(partition: DataFrame, parts: DataFrame) -> DataFrame:
    """Per image: region sizes, and whether protected and exposed together are exactly the union of the parts."""
    union = parts.where("a > 0").select(*PX).distinct().groupBy("image_id").agg(F.count("*").alias("union_pixels"))
    count = lambda r: F.count_if(F.col("region") == r).alias(r)
    sizes = partition.groupBy("image_id").agg(count("protected"), count("exposed"), count("omission"))
    return sizes.join(union, "image_id", "left").na.fill(0, ["union_pixels"]).withColumn("complete", F.expr("protected + exposed = union_pixels"))


def visible_rgb_mismatch(parts: DataFrame, source: DataFrame, reconstruction: DataFrame, threshold: int = 31) -> DataFrame:
    """Per image: winners whose colour differs from visible source, and reconstruction colour and alpha mismatches."""
    colour = F.struct("r", "g", "b")
    won = parts.join(front_winner(parts), PX).where("priority = winner").select(*PX, colour.alias("p"))
    src = source.select(*PX, colour.alias("s"), (F.col("a") > threshold).alias("seen"))
    rec = reconstruction.select(*PX, colour.alias("c"), F.col("a").alias("ca"))
    both = src.join(won, PX, "left").join(rec, PX, "left").join(union_alpha(parts), PX, "left")
    return both.groupBy("image_id").agg(
        F.count_if(F.expr("seen and p is not null and p <> s")).alias("visible_mismatches"),
        F.count_if(F.expr("coalesce(union_a, 0) > 0 and not (c <=> s)")).alias("reconstruction_mismatches"),
        F.count_if(F.expr("coalesce(ca, 0) <> coalesce(union_a, 0)")).alias("alpha_mismatches"))


def composite_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Worst channel delta per image between two composites; an absent pixel is transparent black."""
    l = left.select(*PX, *[F.col(c).alias(f"l{c}") for c in "rgba"])
    r = right.select(*PX, *[F.col(c).alias(f"r{c}") for c in "rgba"])
    delta = F.greatest(*[F.abs(F.coalesce(F.col(f"l{c}"), F.lit(0)) - F.coalesce(F.col(f"r{c}"), F.lit(0))) for c in "rgba"])
    return l.join(r, PX, "full").groupBy("image_id").agg(F.max(delta).alias("worst"), F.count_if(delta > 0).alias("deviating"))


def neutral_compare(expected: DataFrame, actual: DataFrame, threshold: int = 15) -> DataFrame:
    """Exact colour ratio and mean absolute error over the visible pixels of ``expected``; sums are integers until the end."""
    seen = expected.where(F.col("a") > threshold).select(*PX, "r", "g", "b")
    other = actual.select(*PX, *[F.col(c).alias(f"o{c}") for c in "rgb"])
    d = {c: F.abs(F.col(c) - F.coalesce(F.col(f"o{c}"), F.lit(0))) for c in "rgb"}
    sums = seen.join(other, PX, "left").groupBy("image_id").agg(
        F.count("*").alias("visible"), F.count_if((d["r"] + d["g"] + d["b"]) == 0).alias("exact"), *[F.sum(d[c]).alias(f"d{c}") for c in "rgb"])
    return sums.select("image_id", "visible", F.round(F.expr("exact / visible"), 6).alias("exact_ratio"),
                       F.round(F.expr("(dr / visible + dg / visible + db / visible) / 3"), 6).alias("mae"))


# --- panel projection ---------------------------------------------------------------------------------------------

def fill_pixels(textures: DataFrame, coverage: DataFrame) -> DataFrame:
    """Pixels of a generated fill: the layer's texture with alpha limited by the region's coverage."""
    joined = textures.join(coverage.select(*PX, F.col("v").alias("m")), PX, "left")
    return joined.withColumn("a", F.expr("least(a, coalesce(m, 0))")).drop("m")


def panel_projection(projects: DataFrame, layers: DataFrame, regions: DataFrame, source_name: str, fill_prefix: str, read_me: str) -> DataFrame:
    """Bottom-to-top panel: hidden locked source, every fill directly under its owner, hidden read-me on top; dense ids."""
    common = lambda band: [F.lit(band).alias("band")]
    source = projects.select("project_id", *common(0), F.lit(0).alias("draw_order"), F.lit(0).alias("is_layer"), F.lit("").alias("tie"),
                             F.lit(source_name).alias("name"), F.lit(False).alias("visible"), F.lit(True).alias("locked"), F.lit(255).alias("opacity"))
    own = layers.select("project_id", *common(1), "draw_order", F.lit(1).alias("is_layer"), F.col("layer_id").alias("tie"),
                        F.col("display_name").alias("name"), "visible", F.lit(False).alias("locked"), F.bround(F.col("opacity") * 255).cast("int").alias("opacity"))
    owners = layers.select("project_id", F.col("layer_id").alias("owner_layer_id"), "draw_order", "display_name")
    fills = regions.join(owners, ["project_id", "owner_layer_id"]).select(
        "project_id", *common(1), "draw_order", F.lit(0).alias("is_layer"), F.col("region_id").alias("tie"),
        F.concat(F.lit(fill_prefix), "display_name").alias("name"), F.lit(True).alias("visible"), F.lit(False).alias("locked"), F.lit(255).alias("opacity"))
    top = projects.select("project_id", *common(2), F.lit(0).alias("draw_order"), F.lit(0).alias("is_layer"), F.lit("").alias("tie"),
                          F.lit(read_me).alias("name"), F.lit(False).alias("visible"), F.lit(False).alias("locked"), F.lit(255).alias("opacity"))
    rows = cut(source.unionByName(own).unionByName(fills).unionByName(top))  # read twice below: rows and totals of buckets
    bucket = F.expr("band * 1000000000L + draw_order div 64")
    numbered = hotkeys.row_number(rows, ["project_id"], bucket, ["band", "draw_order", "is_layer", "tie"], "position")
    return numbered.select("project_id", "position", "name", "visible", "locked", "opacity")


def panel_check(expected: DataFrame, actual: DataFrame, source_name: str, fill_prefix: str, read_me: str) -> DataFrame:
    """Differences between an expected and a read-back panel.

    The neighbour above is found by an equi-join on ``position + 1``. The top row is the maximum position; only rows that are wrong for
    another reason, or have no neighbour above, are held against it.
    """
    fields = ("name", "visible", "opacity", "locked")
    e = expected.select("project_id", "position", *[F.col(c).alias(f"e_{c}") for c in fields])
    a = actual.select("project_id", "position", *fields, "blend")
    above = actual.select("project_id", (F.col("position") - 1).alias("position"), F.col("name").alias("above"), F.lit(True).alias("covered"))
    top = actual.groupBy("project_id").agg(F.max("position").alias("top"))
    early = F.expr(f"""
        case when e_name is null or name is null then 'LAYER_COUNT' when name <> e_name then 'ORDER' when visible <> e_visible then 'VISIBILITY'
             when opacity <> e_opacity then 'OPACITY' when locked <> e_locked then 'LOCK' when blend <> 'norm' then 'BLEND'
             when position = 1 and (name <> '{source_name}' or visible or not locked) then 'SOURCE_NOT_FIRST' end""")
    late = F.expr(f"case when startswith(name, '{fill_prefix}') and not (above <=> substring(name, {len(fill_prefix) + 1})) then 'FILL_NOT_UNDER_OWNER' end")
    joined = e.join(a, ["project_id", "position"], "full").join(above, ["project_id", "position"], "left").select(
        "project_id", "position", early.alias("early"), late.alias("late"), F.expr(f"covered is null and name <> '{read_me}'").alias("maybe_top"))
    suspects = joined.where("early is not null or late is not null or maybe_top").join(top, "project_id", "left")
    reason = F.expr("case when early is not null then early when maybe_top and position = top then 'READ_ME_NOT_LAST' else late end")
    return suspects.withColumn("reason", reason).where("reason is not null").select("project_id", "position", "reason")


def slot_bits(slot: str) -> int:
    """Bit mask of the parts whose union forms a slot."""
    return sum(1 << fixed.PART_PRIORITY.index(p) for p in fixed.SLOT_PARTS[slot])


def ontology_from_parts(parts: DataFrame, images: DataFrame) -> DataFrame:
    """Slot status from the union of parts; side slots count only their half canvas (character left is screen right).

    Parts present at a pixel become one bit set (``bit_or``), so 16 slot counts are one aggregate over pixels and no
    pixel is exploded per slot.
    """
    bits = parts.where("a > 0").groupBy(*PX).agg(F.bit_or(F.expr("shiftleft(1L, cast(priority as int))")).alias("bits"))
    joined = bits.join(images.select("image_id", "width"), "image_id")
    counts = []
    for i, (slot, _, side, _, _) in enumerate(fixed.SLOTS):
        half = {"left": "x >= width div 2", "right": "x < width div 2"}.get(side, "true")
        counts.append(F.count_if(F.expr(f"bits & {slot_bits(slot)}L <> 0 and {half}")).alias(f"s{i}"))
    wide = images.select("image_id").join(joined.groupBy("image_id").agg(*counts), "image_id", "left").na.fill(0)
    rows = F.array(*[F.struct(F.lit(slot).alias("slot_id"), F.lit(app).alias("applicability"), F.col(f"s{i}").alias("pixels"))
                     for i, (slot, _, _, _, app) in enumerate(fixed.SLOTS)])
    status = F.expr("case when pixels > 0 then 'PRESENT' when applicability = 'required' then 'LOW_CONFIDENCE' else 'NOT_APPLICABLE' end")
    return wide.select("image_id", F.inline(rows)).withColumn("status", status)


def required_slot_facts(ontology: DataFrame) -> DataFrame:
    required = F.col("applicability") == "required"
    return ontology.groupBy("image_id").agg(F.count_if(required & (F.col("status") == "PRESENT")).alias("present"), F.count_if(required).alias("required"))
