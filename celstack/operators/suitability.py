"""Suitability policy: one aggregate per image, then a projection of observations and a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import PX, box_aggregates

VISIBLE_ALPHA = 31


def subject_facts(pixels: DataFrame, images: DataFrame, threshold: int = VISIBLE_ALPHA) -> DataFrame:
    """Per image: visible count, the opaque flag, subject coverage and the subject's box, in one aggregation.

    A canvas that is visible everywhere has no alpha to read, so the whole canvas is the subject.
    """
    visible = F.col("a") > threshold
    facts = pixels.groupBy("image_id").agg(F.count_if(visible).alias("visible"), *box_aggregates(visible))
    canvas = images.select("image_id", F.col("width").alias("canvas_width"), F.col("height").alias("canvas_height"))
    joined = canvas.join(facts, "image_id", "left").na.fill(0, ["visible", "x", "y", "width", "height"])
    total = F.expr("cast(canvas_width as bigint) * canvas_height")
    return joined.withColumn("total", total).withColumn("opaque", F.expr("visible = total")).withColumn(
        "coverage", F.expr("case when total = 0 then 0.0D else visible / total end")
    )


def subject_mask(pixels: DataFrame, facts: DataFrame, threshold: int = VISIBLE_ALPHA) -> DataFrame:
    flag = facts.select("image_id", "opaque")
    value = F.when(F.col("opaque") | (F.col("a") > threshold), 255).otherwise(0)
    return pixels.join(flag, "image_id").select(*PX, value.alias("v"))


# (code, severity, consequence, next step, measurement, condition): fixed policy values, in reporting order.
RULES = (
    ("INPUT_BACKGROUND_NOT_SEPARATED", "review", "generated_layers_will_not_cover_the_background",
     "replace_input_with_cut_out_subject", "1.0D", "opaque"),
    ("INPUT_POSE_OUTSIDE_ENVELOPE", "blocking", "subject_too_small_for_semantic_decomposition",
     "replace_input", "coverage", "coverage < 0.10D"),
    ("INPUT_POSE_OUTSIDE_ENVELOPE", "review", "subject_may_be_cropped_at_the_canvas_edge",
     "inspect_or_replace", "coverage", "coverage > 0.95D and not opaque"),
    ("INPUT_POSE_OUTSIDE_ENVELOPE", "review", "head_may_be_cropped_by_the_canvas",
     "inspect_or_replace", "cast(y as double)", "width > 0 and y <= 2 and not opaque"),
    ("INPUT_POSE_OUTSIDE_ENVELOPE", "review", "composition_may_exceed_the_half_body_envelope",
     "inspect_or_replace", "cast(width as double)", "width > 0 and x <= 2 and x + width >= canvas_width - 2 and coverage > 0.85D"),
    ("INPUT_POSE_OUTSIDE_ENVELOPE", "review", "extreme_aspect_ratio_may_distort_layout_priors",
     "inspect_or_replace", "greatest(canvas_width, canvas_height) / least(canvas_width, canvas_height)",
     "greatest(canvas_width, canvas_height) / least(canvas_width, canvas_height) > 2.0D"),
    ("RASTER_UNTAGGED_ASSUMED_SRGB", "info", "colour_handled_as_srgb",
     "provide_embedded_icc_or_png_srgb", "cast(null as double)", "true"),
)


def observations(facts: DataFrame) -> DataFrame:
    """One row per observation; all rules are evaluated in one narrow projection."""
    entries = [
        F.when(
            F.expr(condition),
            F.struct(F.lit(i).alias("seq"), F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                     F.lit(consequence).alias("consequence"), F.lit(step).alias("next_step"),
                     F.round(F.expr(measure), 6).alias("measurement")),
        )
        for i, (code, severity, consequence, step, measure, condition) in enumerate(RULES)
    ]
    found = F.filter(F.array(*entries), lambda o: o.isNotNull())
    return facts.select("image_id", F.inline(found))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "blocking", 2).when(severity == "review", 1).otherwise(0)


def decision(facts: DataFrame) -> DataFrame:
    """BLOCK over PASS_WITH_WARNINGS over PASS, without exploding the observations."""
    rank = F.greatest(*[
        F.when(F.expr(condition), {"blocking": 2, "review": 1, "info": 0}[severity]).otherwise(0)
        for _, severity, _, _, _, condition in RULES
    ])
    label = F.element_at(F.array(F.lit("PASS"), F.lit("PASS_WITH_WARNINGS"), F.lit("BLOCK")), rank + 1)
    return facts.withColumn("decision", label)


def source_trust(runs: DataFrame) -> DataFrame:
    """Ordered reason list from missing evidence, identity, canonical and reference mismatch.

    Columns: trusted_sha, trusted_rgba, result_source_sha, canonical_rgba, reference_rgba, has_normalization.
    """
    present = "trusted_rgba is not null"
    reasons = F.array_compact(F.array(
        F.when(F.expr(f"not ({present})"), "TRUSTED_SOURCE_EVIDENCE_MISSING"),
        F.when(F.expr(f"{present} and not (trusted_sha <=> result_source_sha)"), "TRUSTED_SOURCE_IDENTITY_MISMATCH"),
        F.when(F.expr(f"{present} and has_normalization and not (canonical_rgba <=> trusted_rgba)"), "TRUSTED_SOURCE_CANONICAL_MISMATCH"),
        F.when(F.expr(f"{present} and not (trusted_rgba <=> reference_rgba)"), "SOURCE_REFERENCE_RGBA_MISMATCH"),
    ))
    origin = F.expr(
        f"case when not ({present}) then 'missing' when has_normalization then 'retained_normalized_input'"
        " else 'imported_retained_input' end"
    )
    return runs.withColumn("reason_codes", reasons).withColumn("evidence_origin", origin).withColumn(
        "status", F.when(F.size("reason_codes") == 0, "pass").otherwise("review_required")
    )
