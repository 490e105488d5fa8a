"""Queries over dense rasters: pixel projections, mask algebra, neighbourhoods and the suitability policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators import suitability as S
from . import inputs as I
from .registry import query
from .inputs import sql


@query("alpha_mask", "image_id:l x:l y:l v:l", sql("SELECT image_id, x, y, a AS v FROM px"))
def _(spark, d):
    return P.alpha_mask(I.pixels(spark, d))


@query("mask_binarize", "image_id:l x:l y:l v:l",
       sql("SELECT image_id, x, y, CASE WHEN v > 31 THEN 255 ELSE 0 END AS v FROM mask_a"))
def _(spark, d):
    return P.binarize(I.mask(spark, d), 31)


@query("mask_count_above", "image_id:l n:l",
       sql("SELECT image_id, count(*) FILTER (WHERE v > 31) AS n FROM mask_a GROUP BY 1"))
def _(spark, d):
    return P.count_above(I.mask(spark, d), 31)


@query("mask_bounds_above", "image_id:l x:l y:l width:l height:l", sql("""
SELECT image_id, coalesce(min(CASE WHEN v > 250 THEN x END), 0) AS x, coalesce(min(CASE WHEN v > 250 THEN y END), 0) AS y,
  coalesce(max(CASE WHEN v > 250 THEN x END) - min(CASE WHEN v > 250 THEN x END) + 1, 0) AS width,
  coalesce(max(CASE WHEN v > 250 THEN y END) - min(CASE WHEN v > 250 THEN y END) + 1, 0) AS height
FROM mask_a GROUP BY 1"""))
def _(spark, d):
    return P.bounds_above(I.mask(spark, d), 250)


@query("mask_intersect", "image_id:l x:l y:l v:l",
       sql("SELECT image_id, x, y, least(l.v, r.v) AS v FROM mask_a l JOIN mask_b r USING (image_id, x, y)"))
def _(spark, d):
    return P.combine_masks(I.mask(spark, d), I.shifted_mask(spark, d), "intersect")


@query("mask_subtract", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, greatest(0, l.v - coalesce(r.v, 0)) AS v FROM mask_a l LEFT JOIN mask_b r USING (image_id, x, y)"""))
def _(spark, d):
    return P.combine_masks(I.mask(spark, d), I.shifted_mask(spark, d), "subtract")


@query("mask_union", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, max(v) AS v FROM (SELECT * FROM mask_a UNION ALL SELECT * FROM mask_b) GROUP BY 1, 2, 3"""))
def _(spark, d):
    return P.combine_masks(I.mask(spark, d), I.shifted_mask(spark, d), "union")


@query("alpha_multiply", "image_id:l x:l y:l r:l g:l b:l a:l", sql("""
SELECT image_id, x, y, r, g, b, (a * coalesce(v, 0) + 127) // 255 AS a FROM px LEFT JOIN mask_b USING (image_id, x, y)"""))
def _(spark, d):
    return P.multiply_alpha(I.pixels(spark, d), I.shifted_mask(spark, d))


@query("alpha_replace", "image_id:l x:l y:l r:l g:l b:l a:l", sql("""
SELECT image_id, x, y, r, g, b, coalesce(v, 0) AS a FROM px LEFT JOIN mask_b USING (image_id, x, y)"""))
def _(spark, d):
    return P.replace_alpha(I.pixels(spark, d), I.shifted_mask(spark, d))


def _inner_box(spark, d):
    """A box derived from each image's declared geometry."""
    return I.images(spark, d).select(
        "image_id", F.expr("image_id % 7").alias("x"), F.expr("height div 4").alias("y"),
        F.expr("width div 2").alias("width"), F.expr("height div 2").alias("height"),
    )


I.CTES["inner_box"] = "SELECT image_id, image_id % 7 AS bx, height // 4 AS bye, width // 2 AS bw, height // 2 AS bh FROM img"


@query("crop_pixels", "image_id:l x:l y:l r:l g:l b:l a:l", sql("""
SELECT image_id, x - bx AS x, y - bye AS y, r, g, b, a FROM px JOIN inner_box USING (image_id)
WHERE x >= bx AND x < bx + bw AND y >= bye AND y < bye + bh"""))
def _(spark, d):
    return P.crop(I.pixels(spark, d), _inner_box(spark, d))


@query("crop_errors", "image_id:l reason:s", sql("""
SELECT image_id, CASE WHEN bh <= 0 THEN 'EMPTY_BOX' WHEN image_id % 5 + bw > width THEN 'OUTSIDE_CANVAS' END AS reason
FROM (SELECT image_id, width, height, CASE WHEN image_id % 3 = 0 THEN 0 ELSE height // 2 END AS bh, width - 1 AS bw FROM img)
WHERE bh <= 0 OR image_id % 5 + bw > width"""))
def _(spark, d):
    boxes = I.images(spark, d).select(
        "image_id", F.expr("image_id % 5").alias("x"), F.lit(0).alias("y"), F.expr("width - 1").alias("width"),
        F.expr("if(image_id % 3 = 0, 0, height div 2)").alias("height"),
    )
    return P.crop_errors(I.images(spark, d), boxes)


@query("channel_planes", "image_id:l x:l y:l channel:s sample:l", sql("""
SELECT image_id, x, y, unnest(['r', 'g', 'b', 'a']) AS channel, unnest([r, g, b, a]) AS sample FROM px"""))
def _(spark, d):
    return P.channel_planes(I.pixels(spark, d))


@query("mask_dilate", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v
FROM (SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v
      FROM mask_a)"""))
def _(spark, d):
    return P.dilate(I.mask(spark, d), 2)


@query("mask_feather", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, CAST(sum(v) OVER w AS BIGINT) // (count(v) OVER w) AS v
FROM (SELECT image_id, x, y, CAST(sum(v) OVER w AS BIGINT) // (count(v) OVER w) AS v FROM mask_a
      WINDOW w AS (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
WINDOW w AS (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""))
def _(spark, d):
    return P.feather(I.mask(spark, d), 3)


@query("region_mask", "image_id:l slot:s x:l y:l v:l", sql("""
SELECT image_id, slot, x, y, v FROM mask_a JOIN (
  SELECT image_id, 'upper' AS slot, 4 AS rx, 0 AS ry, width - 8 AS rw, height // 2 AS rh FROM img UNION ALL
  SELECT image_id, 'lower' AS slot, 0 AS rx, height // 3 AS ry, width // 2 AS rw, height // 3 AS rh FROM img) USING (image_id)
WHERE x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh"""))
def _(spark, d):
    boxes = I.images(spark, d).selectExpr(
        "image_id",
        "inline(array(named_struct('slot', 'upper', 'x', 4, 'y', 0L, 'width', width - 8, 'height', height div 2),"
        " named_struct('slot', 'lower', 'x', 0, 'y', height div 3, 'width', cast(width div 2 as int), 'height', height div 3)))",
    )
    return P.region_mask(I.mask(spark, d), boxes, ["slot"])


@query("edge_feather", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, least(255, (255 * least(2 * x + 1, 2 * (width - x) - 1, 2 * y + 1, 2 * (height - y) - 1) + 2) // 4) AS v
FROM px JOIN img USING (image_id)"""))
def _(spark, d):
    return P.edge_feather(I.pixels(spark, d), I.images(spark, d))


@query("alpha_clean", "image_id:l x:l y:l a:l",
       sql("SELECT image_id, x, y, ((greatest(a, 31) - 31) * 255 + 112) // 224 AS a FROM px"))
def _(spark, d):
    return P.clean_alpha(I.pixels(spark, d), 31)


@query("alpha_tighten", "image_id:l x:l y:l feature:b a:l", sql("""
SELECT image_id, x, y, true AS feature, CASE WHEN a <= 28 THEN 0 WHEN a >= 220 THEN 255
  ELSE round_even((a - 28) * 255 / 192, 0) END AS a FROM px UNION ALL
SELECT image_id, x, y, false AS feature, CASE WHEN a <= 8 THEN 0 WHEN a >= 247 THEN 255
  ELSE round_even((a - 8) * 255 / 239, 0) END AS a FROM px"""))
def _(spark, d):
    p = I.pixels(spark, d)
    return P.tighten_alpha(p, True).withColumn("feature", F.lit(True)).unionByName(
        P.tighten_alpha(p, False).withColumn("feature", F.lit(False)))


@query("detail_alpha", "image_id:l x:l y:l r:l g:l b:l a:l", sql("""
SELECT image_id, x, y, r, g, b, ((t >> 8) + t) >> 8 AS a FROM (
  SELECT image_id, x, y, r, g, b, CAST(CASE WHEN l <= 145 THEN 255 WHEN l >= 210 THEN 0
         ELSE round_even((210 - l) * 255 / 65, 0) END AS BIGINT) * v + 128 AS t
  FROM (SELECT *, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS l FROM px) JOIN mask_b USING (image_id, x, y))"""))
def _(spark, d):
    layer = I.shifted_mask(spark, d).withColumnRenamed("v", "a")
    return P.detail_alpha(I.pixels(spark, d), layer)


@query("matte_apply", "image_id:l x:l y:l a:l", sql("""
SELECT image_id, x, y, least(a, coalesce(v, 0)) AS a FROM px LEFT JOIN mask_b USING (image_id, x, y)"""))
def _(spark, d):
    return P.apply_matte(I.pixels(spark, d), I.shifted_mask(spark, d))


@query("rgba_diff_mask", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, CASE WHEN (a * coalesce(v, 0) + 127) // 255 <> a THEN 255 ELSE 0 END AS v
FROM px LEFT JOIN mask_b USING (image_id, x, y)"""))
def _(spark, d):
    p = I.pixels(spark, d)
    return P.rgba_diff_mask(p, P.multiply_alpha(p, I.shifted_mask(spark, d)))


@query("frame_luma_stats", "image_id:l mean:d deviation:d frame_class:s", sql("""
SELECT image_id, round(mean, 6) AS mean, round(deviation, 6) AS deviation,
  CASE WHEN mean < 12 OR (mean < 70 AND deviation < 2.5) THEN 'blocked' ELSE 'usable' END AS frame_class
FROM (SELECT image_id, s / (n * 10000.0::DOUBLE) AS mean,
        sqrt(greatest(0.0, CAST(q AS DOUBLE) / n / 1e8 - pow(s / (n * 10000.0::DOUBLE), 2))) AS deviation
      FROM (SELECT image_id, count(*) AS n, CAST(sum(l) AS BIGINT) AS s, sum(l * l) AS q
            FROM (SELECT image_id, CAST(2126 * r + 7152 * g + 722 * b AS BIGINT) AS l FROM px) GROUP BY 1))"""))
def _(spark, d):
    return P.frame_luma_stats(I.pixels(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn(
        "deviation", F.round("deviation", 6))


@query("raster_pack_round_trip", "image_id:l width:l height:l bytes:l digest:s mismatches:l", sql("""
SELECT image_id, 64 AS width, count(*) // 64 AS height, count(*) * 4 AS bytes,
  sha256(unhex(string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' ORDER BY y, x))) AS digest, 0 AS mismatches
FROM px GROUP BY 1"""))
def _(spark, d):
    p = I.pixels(spark, d)
    packed = P.pack_pixels(p)
    exploded = P.explode_pixels(packed)
    same = P.rgba_diff_mask(exploded, p).groupBy("image_id").agg(F.count_if(F.col("v") > 0).alias("mismatches"))
    return packed.join(same, "image_id").select(
        "image_id", "width", "height", F.octet_length("rgba").alias("bytes"), F.sha2("rgba", 256).alias("digest"), "mismatches")


@query("orient_pixels", "image_id:l x:l y:l a:l", sql("""
SELECT image_id,
  CASE WHEN o IN (2, 3) THEN width - 1 - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN height - 1 - y ELSE x END AS x,
  CASE WHEN o IN (3, 4) THEN height - 1 - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN width - 1 - x ELSE y END AS y, a
FROM px JOIN (SELECT *, image_id % 8 + 1 AS o FROM img) USING (image_id)"""))
def _(spark, d):
    return P.orient(I.pixels(spark, d), I.images(spark, d).withColumn("orientation", F.expr("image_id % 8 + 1")))


@query("square_resample", "image_id:l x:l y:l r:l g:l b:l a:l", sql("""
SELECT image_id, x, y, least(255, floor(r / 4.0 + 0.5)) AS r, least(255, floor(g / 4.0 + 0.5)) AS g,
  least(255, floor(b / 4.0 + 0.5)) AS b, least(255, floor(a / 4.0 + 0.5)) AS a
FROM (SELECT image_id, x // 2 AS x, (y + (64 - height) // 2) // 2 AS y, sum(r) AS r, sum(g) AS g, sum(b) AS b, sum(a) AS a
      FROM px JOIN img USING (image_id) GROUP BY 1, 2, 3)"""))
def _(spark, d):
    return P.square_resample(I.pixels(spark, d), I.images(spark, d), 32)


FACTS = """
SELECT image_id, width AS cw, height AS ch, total, visible, bx, bye, bw, bh, visible = total AS opaque, visible / total AS coverage
FROM (SELECT image_id, width, height, width * height AS total FROM img) JOIN (
  SELECT image_id, count(*) FILTER (WHERE a > 31) AS visible, coalesce(min(x) FILTER (WHERE a > 31), 0) AS bx,
    coalesce(min(y) FILTER (WHERE a > 31), 0) AS bye,
    coalesce(max(x) FILTER (WHERE a > 31) - min(x) FILTER (WHERE a > 31) + 1, 0) AS bw,
    coalesce(max(y) FILTER (WHERE a > 31) - min(y) FILTER (WHERE a > 31) + 1, 0) AS bh FROM vpx GROUP BY 1) USING (image_id)"""
I.CTES["vpx"] = ("SELECT image_id, x, y, CASE WHEN image_id % 4 = 1 THEN greatest(a, 200) WHEN image_id % 4 = 2 AND (x < 20 OR y < 20)"
                 " THEN 0 WHEN image_id % 4 = 3 AND a < 240 THEN 0 ELSE a END AS a FROM px")
I.CTES["facts"] = FACTS


def _varied(spark, d):
    """Alpha altered per image so that opaque, boxed and sparse subjects all occur."""
    alpha = ("case when image_id % 4 = 1 then greatest(a, 200) when image_id % 4 = 2 and (x < 20 or y < 20) then 0"
             " when image_id % 4 = 3 and a < 240 then 0 else a end")
    return I.pixels(spark, d).withColumn("a", F.expr(alpha))


def _facts(spark, d):
    return S.subject_facts(_varied(spark, d), I.images(spark, d))


@query("subject_mask", "image_id:l x:l y:l v:l", sql("""
SELECT image_id, x, y, CASE WHEN opaque OR a > 31 THEN 255 ELSE 0 END AS v FROM vpx JOIN facts USING (image_id)"""))
def _(spark, d):
    return S.subject_mask(_varied(spark, d), _facts(spark, d))


@query("suitability_observations", "image_id:l seq:l code:s severity:s consequence:s measurement:d", sql("""
SELECT image_id, 0 AS seq, 'INPUT_BACKGROUND_NOT_SEPARATED' AS code, 'review' AS severity,
  'generated_layers_will_not_cover_the_background' AS consequence, 1.0 AS measurement FROM facts WHERE opaque UNION ALL
SELECT image_id, 1, 'INPUT_POSE_OUTSIDE_ENVELOPE', 'blocking', 'subject_too_small_for_semantic_decomposition', round(coverage, 6)
  FROM facts WHERE coverage < 0.1 UNION ALL
SELECT image_id, 2, 'INPUT_POSE_OUTSIDE_ENVELOPE', 'review', 'subject_may_be_cropped_at_the_canvas_edge', round(coverage, 6)
  FROM facts WHERE coverage > 0.95 AND NOT opaque UNION ALL
SELECT image_id, 3, 'INPUT_POSE_OUTSIDE_ENVELOPE', 'review', 'head_may_be_cropped_by_the_canvas', bye
  FROM facts WHERE bw > 0 AND bye <= 2 AND NOT opaque UNION ALL
SELECT image_id, 4, 'INPUT_POSE_OUTSIDE_ENVELOPE', 'review', 'composition_may_exceed_the_half_body_envelope', bw
  FROM facts WHERE bw > 0 AND bx <= 2 AND bx + bw >= cw - 2 AND coverage > 0.85 UNION ALL
SELECT image_id, 5, 'INPUT_POSE_OUTSIDE_ENVELOPE', 'review', 'extreme_aspect_ratio_may_distort_layout_priors',
  round(greatest(cw, ch) / least(cw, ch), 6) FROM facts WHERE greatest(cw, ch) / least(cw, ch) > 2 UNION ALL
SELECT image_id, 6, 'RASTER_UNTAGGED_ASSUMED_SRGB', 'info', 'colour_handled_as_srgb', NULL FROM facts"""))
def _(spark, d):
    return S.observations(_facts(spark, d))


@query("suitability_decision", "image_id:l visible:l coverage:d x:l y:l width:l height:l opaque:b decision:s", sql("""
SELECT image_id, visible, round(coverage, 6) AS coverage, bx AS x, bye AS y, bw AS width, bh AS height, opaque,
  CASE WHEN coverage < 0.1 THEN 'BLOCK'
       WHEN opaque OR coverage > 0.95 OR bye <= 2 OR (bx <= 2 AND bx + bw >= cw - 2 AND coverage > 0.85)
         OR greatest(cw, ch) / least(cw, ch) > 2 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS decision
FROM facts"""))
def _(spark, d):
    return S.decision(_facts(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query("source_trust", "run_id:l reasons:s origin:s status:s", sql("""
SELECT doc_id AS run_id, concat_ws(',',
    CASE WHEN t IS NULL THEN 'TRUSTED_SOURCE_EVIDENCE_MISSING' END,
    CASE WHEN t IS NOT NULL AND doc_id % 5 = 0 THEN 'TRUSTED_SOURCE_IDENTITY_MISMATCH' END,
    CASE WHEN t IS NOT NULL AND doc_id % 2 = 0 AND lang IS DISTINCT FROM 'en' THEN 'TRUSTED_SOURCE_CANONICAL_MISMATCH' END,
    CASE WHEN t IS NOT NULL AND t IS DISTINCT FROM ref THEN 'SOURCE_REFERENCE_RGBA_MISMATCH' END) AS reasons,
  CASE WHEN t IS NULL THEN 'missing' WHEN doc_id % 2 = 0 THEN 'retained_normalized_input' ELSE 'imported_retained_input' END AS origin,
  CASE WHEN t IS NOT NULL AND doc_id % 5 <> 0 AND NOT (doc_id % 2 = 0 AND lang IS DISTINCT FROM 'en') AND t IS NOT DISTINCT FROM ref
    THEN 'pass' ELSE 'review_required' END AS status
FROM (SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN sha256(text) END AS t,
        CASE WHEN l.toxic = 1 THEN sha256(text || '!') ELSE sha256(text) END AS ref
      FROM documents d LEFT JOIN labels l USING (doc_id))"""))
def _(spark, d):
    # evidence exists for labelled documents; toxic labels stand for a differing reference, languages for canonical form
    docs = I.table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("own"), F.sha2(F.concat("text", F.lit("!")), 256).alias("other"))
    labels = I.table(spark, d, "labels").select("doc_id", "toxic", F.lit(True).alias("labelled"))
    runs = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("run_id"),
        F.expr("if(labelled, own, null)").alias("trusted_sha"), F.expr("if(labelled, own, null)").alias("trusted_rgba"),
        F.expr("if(doc_id % 5 = 0, other, own)").alias("result_source_sha"),
        F.expr("if(lang = 'en', own, other)").alias("canonical_rgba"),
        F.expr("if(toxic = 1, other, own)").alias("reference_rgba"),
        F.expr("doc_id % 2 = 0").alias("has_normalization"),
    )
    return S.source_trust(runs).select("run_id", F.array_join("reason_codes", ",").alias("reasons"), F.col("evidence_origin").alias("origin"), "status")
