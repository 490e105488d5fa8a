"""Pixel and mask algebra on long-form tables keyed by ``(image_id, x, y)``.

Point-wise operators are narrow projections. Binary operators are equi-joins on the full pixel key, which spreads
one huge image over every partition. Neighbourhood operators are separable: one window along a raster row, one
along a raster column, so a window group is never longer than one canvas side (bounded by ``MAX_SIDE``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixelmath as pm

PX = ["image_id", "x", "y"]
MAX_SIDE = 16384
MAX_PIXELS = 64 * 1024 * 1024


def alpha_mask(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PX, F.col("a").alias("v"))


def binarize(mask: DataFrame, threshold: int) -> DataFrame:
    """255 where coverage is strictly above the threshold, otherwise 0."""
    return mask.withColumn("v", F.when(F.col("v") > threshold, 255).otherwise(0))


def count_above(mask: DataFrame, threshold: int, by: list[str] = ["image_id"]) -> DataFrame:
    return mask.groupBy(*by).agg(F.count_if(F.col("v") > threshold).alias("n"))


def box_aggregates(inside: Column, x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates giving the tight box (right and bottom exclusive) of rows where ``inside`` holds."""
    px, py = F.when(inside, F.col(x)), F.when(inside, F.col(y))
    return [
        F.coalesce(F.min(px), F.lit(0)).alias("x"),
        F.coalesce(F.min(py), F.lit(0)).alias("y"),
        F.coalesce(F.max(px) - F.min(px) + 1, F.lit(0)).alias("width"),
        F.coalesce(F.max(py) - F.min(py) + 1, F.lit(0)).alias("height"),
    ]


def bounds_above(mask: DataFrame, threshold: int, by: list[str] = ["image_id"]) -> DataFrame:
    """Tight box of coverage above the threshold; the all-zero box when there is none."""
    return mask.groupBy(*by).agg(*box_aggregates(F.col("v") > threshold))


def combine_masks(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``intersect`` = min, ``subtract`` = max(0, l - r), ``union`` = max; an absent sample is 0."""
    kinds = {"intersect": "inner", "subtract": "left", "union": "full"}
    joined = left.select(*PX, F.col("v").alias("lv")).join(right.select(*PX, F.col("v").alias("rv")), PX, kinds[how])
    value = {
        "intersect": "least(lv, rv)",
        "subtract": "greatest(0, lv - coalesce(rv, 0))",
        "union": "greatest(coalesce(lv, 0), coalesce(rv, 0))",
    }[how]
    return joined.select(*PX, F.expr(value).alias("v"))


def geometry_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Images whose declared width and height differ between two rasters or masks that are to be combined."""
    return (
        left.select("image_id", F.struct("width", "height").alias("l"))
        .join(right.select("image_id", F.struct("width", "height").alias("r")), "image_id", "full")
        .where(~F.col("l").eqNullSafe(F.col("r")))
        .select("image_id", "l.width", "l.height", F.col("r.width").alias("other_width"), F.col("r.height").alias("other_height"))
    )


def multiply_alpha(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Scale alpha by coverage; a pixel without a mask sample becomes transparent."""
    joined = pixels.join(mask.select(*PX, "v"), PX, "left")
    return joined.withColumn("a", F.expr(pm.scale_u8("a", "coalesce(v, 0)"))).drop("v")


def replace_alpha(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    joined = pixels.join(mask.select(*PX, "v"), PX, "left")
    return joined.withColumn("a", F.coalesce("v", F.lit(0))).drop("v")


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Keep the pixels inside each image's box and move the origin to its corner.

    ``boxes`` has one row per image, so the join can neither fan out nor need a broadcast to be correct; images
    whose box is empty or leaves the canvas are rejected by ``crop_errors``.
    """
    box = boxes.select("image_id", F.col("x").alias("bx"), F.col("y").alias("by"), "width", "height")
    inside = "x >= bx and x < bx + width and y >= by and y < by + height"
    return (
        pixels.join(box, "image_id").where(inside)
        .withColumn("x", F.col("x") - F.col("bx")).withColumn("y", F.col("y") - F.col("by"))
        .drop("bx", "by", "width", "height")
    )


def crop_errors(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per image whose crop box is empty or falls outside the canvas."""
    canvas = images.select("image_id", F.col("width").alias("cw"), F.col("height").alias("ch"))
    reason = F.expr(
        "case when width <= 0 or height <= 0 then 'EMPTY_BOX'"
        " when x < 0 or y < 0 or x + width > cw or y + height > ch then 'OUTSIDE_CANVAS' end"
    )
    return boxes.join(canvas, "image_id").withColumn("reason", reason).where("reason is not null")


def channel_planes(pixels: DataFrame) -> DataFrame:
    """Wide pixels to one row per channel sample."""
    return pixels.unpivot(PX, ["r", "g", "b", "a"], "channel", "sample")


def _axis_windows(radius: int) -> tuple[Window, Window]:
    along_row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    along_column = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    return along_row, along_column


def dilate(mask: DataFrame, radius: int) -> DataFrame:
    """Square-element dilation of a dense mask, clamped at the canvas edge."""
    if radius <= 0:
        return mask
    row, column = _axis_windows(radius)
    return mask.withColumn("v", F.max("v").over(row)).withColumn("v", F.max("v").over(column))


def feather(mask: DataFrame, radius: int) -> DataFrame:
    """Separable box mean of a dense mask; floor division by the clamped sample count after each pass."""
    if radius <= 0:
        return mask
    row, column = _axis_windows(radius)
    out = mask
    for window in (row, column):
        out = out.withColumn("s", F.sum("v").over(window)).withColumn("c", F.count("v").over(window))
        out = out.withColumn("v", F.expr("s div c")).drop("s", "c")
    return out


def densify(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Fill a sparse mask with zeros over the declared canvas of each image."""
    grid = (
        images.select("image_id", "width", F.explode(F.expr("sequence(0, height - 1)")).alias("y"))
        .select("image_id", "y", F.explode(F.expr("sequence(0, width - 1)")).alias("x"))
    )
    return grid.join(mask.select(*PX, "v"), PX, "left").select(*PX, F.coalesce("v", F.lit(0)).alias("v"))


def region_mask(mask: DataFrame, boxes: DataFrame, tag: list[str]) -> DataFrame:
    """Coverage inside each image's boxes; several boxes per image give several tagged masks.

    The boxes of one image travel as one small array, so every pixel meets one row and emits only its own hits.
    """
    fields = [*tag, "x", "y", "width", "height"]
    renamed = F.struct(*[F.col(c).alias("box_" + c if c in ("x", "y") else c) for c in fields])
    per_image = boxes.groupBy("image_id").agg(F.collect_list(renamed).alias("boxes"))
    hit = "filter(boxes, q -> x >= q.box_x and x < q.box_x + q.width and y >= q.box_y and y < q.box_y + q.height)"
    return (
        mask.join(per_image, "image_id")
        .select(*PX, "v", F.explode(F.expr(hit)).alias("q"))
        .select(*PX, "v", *[F.col(f"q.{c}").alias(c) for c in tag])
    )


def edge_feather(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Coverage that ramps up from the canvas edge over the first pixels."""
    ramp = F.expr(pm.edge_ramp("x", "y", "width", "height"))
    return pixels.join(images.select("image_id", "width", "height"), "image_id").select(*PX, ramp.alias("v"))


def clean_alpha(pixels: DataFrame, floor: int = 31) -> DataFrame:
    return pixels.withColumn("a", F.expr(pm.clean_alpha("a", floor)))


def tighten_alpha(pixels: DataFrame, feature: bool) -> DataFrame:
    """Steepen alpha: features use (28, 220), everything else (8, 247)."""
    low, high = (28, 220) if feature else (8, 247)
    return pixels.withColumn("a", F.expr(pm.ramp("a", low, high)))


def detail_alpha(source: DataFrame, layer: DataFrame) -> DataFrame:
    """Source colours whose alpha is the dark-detail ramp (145..210 of luma) times the layer's alpha."""
    luma = pm.luma_601("r", "g", "b")
    dark = f"case when {luma} <= 145 then 255 when {luma} >= 210 then 0 else cast(bround((210 - {luma}) * 255 / 65) as int) end"
    joined = source.join(layer.select(*PX, F.col("a").alias("layer_a")), PX)
    return (
        joined.withColumn("detail", F.expr(dark))
        .withColumn("a", F.expr(pm.multiply_u8("detail", "layer_a")))
        .drop("detail", "layer_a")
    )


def apply_matte(pixels: DataFrame, matte: DataFrame) -> DataFrame:
    """Limit alpha by a matte; a pixel without a matte sample becomes transparent."""
    joined = pixels.join(matte.select(*PX, F.col("v").alias("m")), PX, "left")
    return joined.withColumn("a", F.expr("least(a, coalesce(m, 0))")).drop("m")


def rgba_diff_mask(left: DataFrame, right: DataFrame) -> DataFrame:
    """255 where any channel differs between two images of the same geometry."""
    pair = left.select(*PX, F.struct("r", "g", "b", "a").alias("p")).join(
        right.select(*PX, F.struct("r", "g", "b", "a").alias("q")), PX
    )
    return pair.select(*PX, F.when(F.col("p") != F.col("q"), 255).otherwise(0).alias("v"))


def frame_luma_stats(pixels: DataFrame) -> DataFrame:
    """Mean and population deviation of 0.2126 R + 0.7152 G + 0.0722 B with the frame class.

    Sums are exact integers (luma times 10,000), so the result does not depend on the order of the rows.
    """
    scaled = pixels.select("image_id", F.expr("cast(2126 * r + 7152 * g + 722 * b as bigint)").alias("l"))
    sums = scaled.groupBy("image_id").agg(
        F.count("l").alias("n"), F.sum("l").alias("s"),
        F.sum(F.expr("cast(l * l as decimal(20, 0))")).alias("q"),
    )
    stats = sums.select(
        "image_id",
        F.expr("s / (n * 10000.0D)").alias("mean"),
        F.expr("sqrt(greatest(0.0D, cast(q as double) / n / 1e8D - pow(s / (n * 10000.0D), 2)))").alias("deviation"),
    )
    return stats.withColumn("frame_class", frame_class(F.col("mean"), F.col("deviation")))


def frame_class(mean: Column, deviation: Column) -> Column:
    """``unavailable`` for missing statistics, ``blocked`` for dark or flat frames, otherwise ``usable``."""
    missing = mean.isNull() | deviation.isNull() | F.isnan(mean) | F.isnan(deviation)
    blocked = (mean < 12) | ((mean < 70) & (deviation < 2.5))
    return F.when(missing, "unavailable").when(blocked, "blocked").otherwise("usable")


def explode_pixels(rasters: DataFrame) -> DataFrame:
    """Row-major interleaved RGBA blobs to one row per pixel, entirely in generated code.

    The blob is cut into per-row slices first, so one very large image becomes many rows before its pixels do.
    """
    rows = rasters.select(
        "image_id", F.posexplode(F.expr("transform(sequence(0, height - 1), i -> substring(rgba, i * width * 4 + 1, width * 4))"))
        .alias("y", "line"), "width",
    )
    cells = rows.select("image_id", "y", F.hex("line").alias("h"), F.explode(F.expr("sequence(0, width - 1)")).alias("x"))
    channel = lambda i: F.expr(f"cast(conv(substring(h, x * 8 + {2 * i + 1}, 2), 16, 10) as int)")
    return cells.select(*PX, *[channel(i).alias(c) for i, c in enumerate("rgba")])


def pack_pixels(pixels: DataFrame, by: list[str] = ["image_id"]) -> DataFrame:
    """Dense pixels back to one RGBA blob per image, packing each raster row before the whole image.

    A raster row is at most ``MAX_SIDE`` pixels and an image at most ``MAX_PIXELS`` by the dimension envelope.
    """
    sample = F.concat(*[F.lpad(F.hex(F.col(c).cast("int")), 2, "0") for c in "rgba"])
    cell = pixels.select(*by, "x", "y", sample.alias("h"))
    line = cell.groupBy(*by, "y").agg(F.array_sort(F.collect_list(F.struct("x", "h"))).alias("cells"))
    line = line.select(*by, "y", F.size("cells").alias("width"), F.expr("array_join(transform(cells, c -> c.h), '')").alias("h"))
    image = line.groupBy(*by).agg(
        F.max("width").alias("width"), F.count("*").alias("height"),
        F.array_sort(F.collect_list(F.struct("y", "h"))).alias("lines"),
    )
    return image.select(*by, "width", "height", F.expr("unhex(array_join(transform(lines, l -> l.h), ''))").alias("rgba"))


def orient(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """The eight EXIF orientations as coordinate remaps; 5 to 8 swap width and height."""
    o = images.select("image_id", "width", "height", "orientation")
    nx = ("case orientation when 2 then width - 1 - x when 3 then width - 1 - x when 5 then y"
          " when 6 then height - 1 - y when 7 then height - 1 - y when 8 then y else x end")
    ny = ("case orientation when 3 then height - 1 - y when 4 then height - 1 - y when 5 then x"
          " when 6 then x when 7 then width - 1 - x when 8 then width - 1 - x else y end")
    joined = pixels.join(o, "image_id").withColumn("nx", F.expr(nx)).withColumn("ny", F.expr(ny))
    return joined.select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), "r", "g", "b", "a")


def square_resample(pixels: DataFrame, images: DataFrame, side: int) -> DataFrame:
    """Centre-pad to a square and resample every channel separately to ``side``: box filter when shrinking,
    bilinear when growing, unchanged when equal.

    Each source pixel is exploded into the few target cells it touches per axis; weights are per-axis, so the
    two-dimensional weight is their product. Sums are normalised by the canvas weights, where padding counts as 0.
    """
    dims = images.select(
        "image_id", F.greatest("width", "height").alias("n"),
        F.expr("(greatest(width, height) - width) div 2").alias("ox"),
        F.expr("(greatest(width, height) - height) div 2").alias("oy"),
    )
    base = pixels.join(dims, "image_id").select(
        "image_id", "n", F.expr("x + ox").alias("sx"), F.expr("y + oy").alias("sy"), "r", "g", "b", "a"
    )
    # support: half a source pixel when growing is one whole pixel (triangle), box of width n/side when shrinking
    def taps(s: str) -> str:
        box = (f"transform(sequence(cast(floor({s} * {side} / n) as int), cast(least({side} - 1, ceil(({s} + 1) * {side} / n) - 1) as int)),"
               f" t -> named_struct('t', t, 'w', least({s} + 1.0D, (t + 1) * n / {side}) - greatest({s} + 0.0D, t * n / {side})))")
        tri = (f"filter(transform(sequence(greatest(0, cast(floor(({s} - 0.5D) * {side} / n - 0.5D) as int)),"
               f" least({side} - 1, cast(ceil(({s} + 1.5D) * {side} / n - 0.5D) as int))),"
               f" t -> named_struct('t', t, 'w', greatest(0.0D, 1.0D - abs((t + 0.5D) * n / {side} - ({s} + 0.5D))))), q -> q.w > 0)")
        return f"case when n >= {side} then {box} else {tri} end"

    spread = base.select("*", F.explode(F.expr(taps("sx"))).alias("qx")).select("*", F.explode(F.expr(taps("sy"))).alias("qy"))
    weighted = spread.select(
        "image_id", "n", F.col("qx.t").alias("x"), F.col("qy.t").alias("y"), F.expr("qx.w * qy.w").alias("w"), "r", "g", "b", "a"
    )
    sums = weighted.groupBy("image_id", "n", "x", "y").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "rgba"])

    def norm(t: str) -> str:
        lo, hi = f"greatest(0, cast(floor(({t} + 0.5D) * n / {side} - 0.5D) as int))", f"least(n - 1, cast(ceil(({t} + 0.5D) * n / {side} - 0.5D) as int))"
        tri = (f"aggregate(sequence({lo}, {hi}), 0.0D, (acc, s) -> acc + greatest(0.0D, 1.0D - abs(({t} + 0.5D) * n / {side} - (s + 0.5D))))")
        return f"case when n >= {side} then n / {side} else {tri} end"

    total = F.expr(f"({norm('x')}) * ({norm('y')})")
    clamp = lambda c: F.expr(f"cast(least(255.0D, greatest(0.0D, floor({c} / total + 0.5D))) as int)").alias(c)
    return sums.withColumn("total", total).select("image_id", "x", "y", *[clamp(c) for c in "rgba"])
