"""Scans of uploads, decoded rasters and run folders.

Each scan is split into a reader and a DataFrame function, so the rules also apply to tables that already hold the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MIN_SIDE, MAX_SIDE, MAX_PIXELS = 1024, 8192, 40_000_000
MEDIA_TYPES = ("image/png", "image/jpeg")


def sniffed_type(content: Column) -> Column:
    """Container by magic bytes, null when it is neither PNG nor JPEG."""
    png = F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    jpeg = F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF"))
    return F.when(png, "image/png").when(jpeg, "image/jpeg")


def upload_verdicts(uploads: DataFrame) -> DataFrame:
    """First reason to reject each upload ``(content, length, declared_type)``, null when it is accepted."""
    declared = F.col("declared_type")
    reason = (
        F.when((F.col("length") == 0) | F.col("content").isNull(), "INPUT_UNSUPPORTED")
        .when(F.col("length") > MAX_UPLOAD_BYTES, "STAGE_RESOURCE_LIMIT_EXCEEDED")
        .when(declared.isNull() | ~declared.isin(*MEDIA_TYPES), "INPUT_UNSUPPORTED")
        .when(F.col("sniffed_type").isNull(), "INPUT_UNSUPPORTED")
        .when(F.col("sniffed_type") != declared, "INPUT_UNSUPPORTED")
    )
    return uploads.withColumn("sniffed_type", sniffed_type(F.col("content"))).withColumn("reason_code", reason).withColumn(
        "sha256", F.when(F.col("reason_code").isNull(), F.sha2("content", 256)))


def scan_uploads(spark: SparkSession, path: str, declared_types: DataFrame) -> DataFrame:
    """Uploaded files against their declared types ``(path, declared_type)``, in both directions: the file source skips
    empty files, so a declared upload without bytes is rejected here rather than lost."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    return upload_verdicts(files.join(declared_types, "path", "full")).drop("content")


def scan_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Every file as ``(image_id, width, height, channels, data, reason_code)``; only decoded images have pixels.

    The JVM image source decodes. It stores rows from the top, each pixel as blue, green, red and, with four channels,
    straight alpha; one channel is grey. A file that cannot be read, or has another number of channels, keeps its row with
    null dimensions and a reason code.
    """
    raw = spark.read.format("image").load(path).select("image.*")
    reason = F.expr("case when width <= 0 or height <= 0 then 'INPUT_CORRUPT' when nChannels not in (1, 3, 4) then 'INPUT_UNSUPPORTED' end")
    known = raw.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data", reason.alias("reason_code"))
    return known.select("image_id", *[F.when(F.col("reason_code").isNull(), F.col(c)).alias(c) for c in ("width", "height", "channels", "data")], "reason_code")


def raster_pixels(rasters: DataFrame) -> DataFrame:
    """Scanned images to one RGBA row per pixel; a missing alpha channel is opaque.

    The blob is cut into raster rows before pixels are made, so no intermediate grows with the image.
    """
    rows = rasters.where("data is not null").select("image_id", "width", "channels", F.posexplode(F.expr(
        "transform(sequence(0, height - 1), i -> substring(data, i * width * channels + 1, width * channels))")).alias("y", "line"))
    cells = rows.select("image_id", "y", "channels", F.hex("line").alias("h"), F.explode(F.expr("sequence(0, width - 1)")).alias("x"))
    sample = lambda k: F.expr(f"cast(conv(substring(h, (x * channels + {k}) * 2 + 1, 2), 16, 10) as int)")
    coloured = lambda k: F.when(F.col("channels") == 1, sample(0)).otherwise(sample(k))
    return cells.select("image_id", "x", "y", coloured(2).alias("r"), coloured(1).alias("g"), coloured(0).alias("b"),
                        F.when(F.col("channels") == 4, sample(3)).otherwise(255).alias("a"))


def raster_facts(images: DataFrame, pixels: DataFrame, min_side: int = MIN_SIDE, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Whether any alpha sample is below 255, and the dimension envelope verdict."""
    lowest = pixels.groupBy("image_id").agg(F.min("a").alias("lowest"))
    reason = F.expr(
        f"case when cast(width as bigint) * height > {max_pixels} then 'STAGE_RESOURCE_LIMIT_EXCEEDED'"
        f" when width not between {min_side} and {max_side} or height not between {min_side} and {max_side} then 'INPUT_UNSUPPORTED' end")
    if "reason_code" in images.columns:  # a scan has already said why a file has no pixels
        reason = F.coalesce("reason_code", reason)
    return images.join(lowest, "image_id", "left").select(
        "image_id", "width", "height", F.coalesce(F.col("lowest") < 255, F.lit(False)).alias("had_alpha"), reason.alias("reason_code"))


def discovered_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Run folders under ``root`` that contain a file ``name``; file bytes are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("run_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("byte_length"))


def newest_verified(bundles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verified bundles, newest first; a global sort is a range-partitioned shuffle, not a single task."""
    good = verdicts.where("verified").select("bundle_id")
    return bundles.join(good, "bundle_id", "left_semi").orderBy(F.col("modified").desc(), "bundle_id")
