"""Queries over near-duplicate families of rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import families as N
from . import inputs as I
from .inputs import sql
from .registry import query

# Every raster, flattened on black, in four forms: as it is, a copy, darker with less contrast, and without its left quarter.
I.CTES["shown"] = """
SELECT image_id, width, height, x, y, (r * a) // 255 AS r, (g * a) // 255 AS g, (b * a) // 255 AS b, 255 AS a FROM px JOIN img USING (image_id)"""
I.CTES["raster_forms"] = """
SELECT image_id * 4 + form AS raster_id, CASE WHEN form = 3 THEN width - 16 ELSE width END AS width, height, CASE WHEN form = 3 THEN x - 16 ELSE x END AS x, y,
  CASE WHEN form = 2 THEN (r * 3) // 4 + 9 ELSE r END AS r, CASE WHEN form = 2 THEN (g * 3) // 4 + 5 ELSE g END AS g, CASE WHEN form = 2 THEN (b * 3) // 4 ELSE b END AS b, a
FROM shown, (SELECT unnest(range(0, 4)) AS form) WHERE form < 3 OR x >= 16"""
I.CTES["thumbs"] = """
SELECT raster_id, width, height, list(mean ORDER BY block) AS thumb, string_agg(whole, '|' ORDER BY block) AS whole FROM (
  SELECT raster_id, width, height, (y * 8 // height) * 9 + x * 9 // width AS block, (sum((2126 * r + 7152 * g + 722 * b) // 10000) * 16) // count(*) AS mean,
         md5(string_agg(concat_ws(',', x, y, r, g, b, a), ';' ORDER BY y, x)) AS whole
  FROM raster_forms GROUP BY ALL) GROUP BY ALL"""
I.CTES["raster_links"] = """
SELECT a, b FROM (
  SELECT p.raster_id AS a, q.raster_id AS b, p.whole = q.whole AND p.width = q.width AND p.height = q.height AS same, len(p.thumb) = 72 AND len(q.thumb) = 72 AS dense,
    list_sum(list_transform(range(0, 64), lambda i: CASE WHEN (p.thumb[(i // 8) * 9 + i % 8 + 1] < p.thumb[(i // 8) * 9 + i % 8 + 2]) <> (q.thumb[(i // 8) * 9 + i % 8 + 1] < q.thumb[(i // 8) * 9 + i % 8 + 2]) THEN 1 ELSE 0 END)) AS bits,
    CAST(72 * list_sum(list_transform(range(1, 73), lambda i: p.thumb[i] * q.thumb[i])) - list_sum(p.thumb) * list_sum(q.thumb) AS DOUBLE) AS cov,
    CAST(72 * list_sum(list_transform(p.thumb, lambda v: v * v)) - list_sum(p.thumb) * list_sum(p.thumb) AS DOUBLE) AS va,
    CAST(72 * list_sum(list_transform(q.thumb, lambda v: v * v)) - list_sum(q.thumb) * list_sum(q.thumb) AS DOUBLE) AS vb
  FROM thumbs p, thumbs q WHERE p.raster_id <> q.raster_id)
WHERE same OR dense AND bits <= 3 AND (cov > 0 AND cov * cov >= 0.9025::DOUBLE * (va * vb) OR va = 0 AND vb = 0)"""


@query("raster_families", "raster_id:l family:l members:l kind:s", sql("SELECT 1 FROM raster_links").replace("WITH ", "WITH RECURSIVE ").replace("SELECT 1 FROM raster_links", "").rstrip() + """,
reach AS (SELECT raster_id AS a, raster_id AS b FROM thumbs UNION SELECT reach.a, raster_links.b FROM reach JOIN raster_links ON reach.b = raster_links.a),
family AS (SELECT a AS raster_id, min(b) AS family FROM reach GROUP BY a)
SELECT f.raster_id, family, count(*) OVER (PARTITION BY family) AS members, CASE WHEN f.raster_id = family THEN 'first' WHEN m.whole = h.whole AND m.width = h.width AND m.height = h.height THEN 'copy'
  WHEN m.width = h.width AND m.height = h.height THEN 'recoloured' ELSE 'resized' END AS kind
FROM family f JOIN thumbs m ON f.raster_id = m.raster_id JOIN thumbs h ON f.family = h.raster_id""")
def _(spark, d):
    pixels = I.pixels(spark, d).select("image_id", "x", "y", *[F.expr(f"({c} * a) div 255").alias(c) for c in "rgb"], F.lit(255).alias("a"))
    forms = pixels.withColumn("form", F.explode(F.expr("sequence(0, 3)"))).where("form < 3 or x >= 16").selectExpr(
        "image_id * 4 + form as raster_id", "if(form = 3, x - 16, x) as x", "y", "if(form = 2, r * 3 div 4 + 9, r) as r", "if(form = 2, g * 3 div 4 + 5, g) as g",
        "if(form = 2, b * 3 div 4, b) as b", "a")
    rasters = I.images(spark, d).withColumn("form", F.explode(F.expr("sequence(0, 3)"))).selectExpr("image_id * 4 + form as raster_id", "if(form = 3, width - 16, width) as width", "height")
    return N.raster_families(rasters, forms)
