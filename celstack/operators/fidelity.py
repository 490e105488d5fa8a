"""Fidelity diagnosis of reconstructions: coverage, omissions, their causes, and counterfactuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import PX

EXACT_MINIMUM = 0.995
MAE_MAXIMUM = 0.5


def neutral_fidelity(source: DataFrame, reconstruction: DataFrame, threshold: int) -> DataFrame:
    """Coverage, exact ratio, error and verdict per image. Verdicts use unrounded values; sums are integers."""
    s = source.select(*PX, "r", "g", "b", (F.col("a") > threshold).alias("sv"))
    r = reconstruction.select(*PX, *[F.col(c).alias(f"o{c}") for c in "rgb"], (F.col("a") > threshold).alias("rv"))
    j = s.join(r, PX, "full")
    d = {c: F.abs(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"o{c}"), F.lit(0))) for c in "rgb"}
    seen = F.coalesce(F.col("sv"), F.lit(False))
    facts = j.groupBy("image_id").agg(
        F.count_if(seen).alias("source_visible"), F.count_if(F.coalesce("rv", F.lit(False))).alias("reconstruction_visible"),
        F.count_if(seen & F.coalesce("rv", F.lit(False))).alias("covered"), F.count_if(seen & (d["r"] + d["g"] + d["b"] == 0)).alias("exact"),
        *[F.coalesce(F.sum(F.when(seen, d[c])), F.lit(0)).alias(f"d{c}") for c in "rgb"])
    raw = facts.withColumn("coverage_raw", F.expr("covered / source_visible")).withColumn("exact_raw", F.expr("exact / source_visible")).withColumn(
        "mae_raw", F.expr("(dr / source_visible + dg / source_visible + db / source_visible) / 3"))
    status = F.expr(f"case when source_visible = 0 then 'no_visible_pixels' when covered = source_visible and exact_raw >= {EXACT_MINIMUM}D"
                    f" and mae_raw <= {MAE_MAXIMUM}D then 'pass' else 'review_required' end")
    return raw.select(
        "image_id", "source_visible", "reconstruction_visible", "covered", F.expr("source_visible - covered").alias("omitted"),
        F.round("coverage_raw", 6).alias("coverage"), F.round("exact_raw", 6).alias("exact_ratio"), F.round("mae_raw", 6).alias("mae"), status.alias("status"))


def omitted_pixels(source: DataFrame, reconstruction: DataFrame, union: DataFrame, threshold: int) -> DataFrame:
    """Visible source pixels the reconstruction misses: H1 when some part is faintly there, H2 when none is."""
    s = source.where(F.col("a") > threshold).select(*PX, F.col("a").alias("source_a"))
    r = reconstruction.where(F.col("a") > threshold).select(*PX)
    missed = s.join(r, PX, "left_anti").join(union.select(*PX, "union_a"), PX, "left").withColumn("union_a", F.coalesce("union_a", F.lit(0)))
    group = F.expr(f"case when union_a = 0 then 'H2' when union_a <= {threshold} then 'H1' else 'invalid' end")
    return missed.withColumn("grp", group)


def omission_split(omitted: DataFrame, threshold: int) -> DataFrame:
    """Per image and group: pixels, source-alpha bins, count at 255, median.

    The exact percentile keeps counts per distinct value, and there are at most 256 alpha values.
    """
    edges = [(threshold + 1, 63), (max(threshold + 1, 64), 127), (max(threshold + 1, 128), 191), (max(threshold + 1, 192), 254), (255, 255)]
    bins = [F.count_if(F.col("source_a").between(lo, hi)).alias(f"bin{i}") for i, (lo, hi) in enumerate(edges)]
    return omitted.groupBy("image_id", "grp").agg(F.count("*").alias("pixels"), *bins, F.percentile("source_a", F.lit(0.5)).alias("median"))


def union_histogram(omitted: DataFrame, images: DataFrame, threshold: int) -> DataFrame:
    """Dense histogram 0..threshold of the union alpha over omitted pixels."""
    dense = images.select("image_id", F.explode(F.expr(f"sequence(0, {threshold})")).alias("union_a"))
    counts = omitted.groupBy("image_id", "union_a").agg(F.count("*").alias("n"))
    return dense.join(counts, ["image_id", "union_a"], "left").na.fill(0, ["n"])


def argmax_parts(omitted: DataFrame, parts: DataFrame) -> DataFrame:
    """Strongest part per H1 pixel, first in part order on ties; tie counts. ``parts``: (pixel, part_index, a).

    Alpha and reversed index are packed into one integer maximum; ties are the parts that reach the pixel's union alpha.
    """
    h1 = omitted.where("grp = 'H1'").select(*PX, "union_a")
    at = h1.join(parts.select(*PX, "part_index", "a"), PX).where("a = union_a")
    best = at.groupBy(*PX).agg(F.min("part_index").alias("part_index"), F.count("*").alias("reached"))
    return best.groupBy("image_id", "part_index").agg(F.count("*").alias("pixels"), F.count_if(F.col("reached") > 1).alias("ties"))


def alpha_preimages(histogram: DataFrame, threshold: int) -> DataFrame:
    """Raw alphas that half-even cleaning maps to each cleaned value seen; at most 255 - threshold candidates per row."""
    span = 255 - threshold
    raw = F.filter(F.expr(f"sequence({threshold + 1}, 255)"), lambda v: F.bround((v - threshold) * 255 / span).cast("int") == F.col("union_a"))
    return histogram.where("union_a > 0 and n > 0").select("image_id", "union_a", raw.alias("preimages"))


def coverage_projection(fidelity: DataFrame, h1: DataFrame) -> DataFrame:
    """Coverage if H1 pixels counted as covered, with the three threshold checks."""
    joined = fidelity.join(h1.select("image_id", F.col("pixels").alias("h1")), "image_id", "left").na.fill(0, ["h1"])
    raw = joined.withColumn("numerator", F.expr("covered + h1")).withColumn("ratio", F.expr("(covered + h1) / source_visible"))
    checks = raw.withColumn("coverage_passes", F.expr("ratio >= 1.0D")).withColumn("exact_passes", F.expr(f"exact_ratio >= {EXACT_MINIMUM}D")).withColumn(
        "mae_passes", F.expr(f"mae <= {MAE_MAXIMUM}D"))
    return checks.select("image_id", "numerator", F.col("source_visible").alias("denominator"), F.round("ratio", 6).alias("ratio"), "coverage_passes",
                         "exact_passes", "mae_passes", F.expr("coverage_passes and exact_passes and mae_passes").alias("all_pass"))


def stored_metric_mismatches(stored: DataFrame, recomputed: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics whose stored value is not exactly the recomputed one (null matches only null)."""
    l = stored.select(*keys, *[F.col(m).alias(f"s_{m}") for m in metrics])
    r = recomputed.select(*keys, *[F.col(m).alias(f"r_{m}") for m in metrics])
    differing = F.array_compact(F.array(*[F.when(~F.col(f"s_{m}").eqNullSafe(F.col(f"r_{m}")), m) for m in metrics]))
    return l.join(r, keys, "full").select(*keys, F.explode(differing).alias("metric"))


BASE_REVIEW_ITEMS = ("semantic_correctness", "hidden_region_completion", "dynamic_visual_quality")


def review_items(fidelity: DataFrame) -> DataFrame:
    """The base review list, plus one warning with actuals and limits when the fidelity gate was not passed."""
    base = F.array(*[F.lit(i) for i in BASE_REVIEW_ITEMS])
    warning = F.concat(
        F.lit("FIDELITY_GATE_NOT_PASSED: neutral fidelity gate was not passed (status=review_required); coverage actual="), F.col("coverage").cast("string"),
        F.lit(f" required==1.0; exact_ratio actual="), F.col("exact_ratio").cast("string"), F.lit(f" required>={EXACT_MINIMUM}; rgb_mae actual="),
        F.col("mae").cast("string"), F.lit(f" required<={MAE_MAXIMUM}"))
    return fidelity.select("image_id", F.when(F.col("status") == "pass", base).otherwise(F.array_append(base, warning)).alias("items"))
