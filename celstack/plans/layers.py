"""Queries over layer proposals, ontology completion, part boxes and bounded completion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import fixed
from ..operators import graph as G
from ..operators import layers as L
from ..operators import pixels as P
from ..session import cut
from ..sources import registries as R
from . import inputs as I
from .compose import parts
from .inputs import sql
from .rasters import _facts, _varied
from .registry import query


def _regions(spark, d) -> DataFrame:
    return L.layout_regions(_facts(spark, d))


BOXES = (
    ("character", "none", "x", "y", "width", "height"), ("hair.back", "none", "hx - hw * 0.12", "hy", "hw * 1.24", "hh * 1.15"),
    ("torso", "none", "x", "ty", "width", "y + height - ty"), ("neck", "none", "mid - fw * 0.30", "ny", "fw * 0.60", "hh * 0.18"),
    ("face.base", "center", "fx", "fy", "fw", "fh"), ("brow.right", "right", "fx + fw * 0.10", "br", "ew", "bh2"), ("brow.left", "left", "mid + fw * 0.10", "br", "ew", "bh2"),
    ("eye.right", "right", "fx + fw * 0.10", "ey", "ew", "eh"), ("eye.left", "left", "mid + fw * 0.10", "ey", "ew", "eh"),
    ("mouth", "center", "mid - mw / 2.0", "my", "mw", "mh"), ("hair.front", "none", "hx", "hy", "hw", "hh * 0.34"),
)
I.CTES["props"] = """
SELECT *, hy + hh * 0.92::DOUBLE AS ny, y + height * 0.46::DOUBLE AS ty, fx + fw / 2.0::DOUBLE AS mid FROM (
 SELECT *, ey - fh * 0.16::DOUBLE AS br, fh * 0.12::DOUBLE AS bh2, fy + fh * 0.70::DOUBLE AS my, fh * 0.18::DOUBLE AS mh, fw * 0.34::DOUBLE AS mw FROM (
  SELECT *, fy + fh * 0.30::DOUBLE AS ey, fh * 0.20::DOUBLE AS eh, fw * 0.30::DOUBLE AS ew FROM (
   SELECT *, hy + hh * 0.22::DOUBLE AS fy, hh * 0.62::DOUBLE AS fh, hx + hw * 0.16::DOUBLE AS fx, hw * 0.68::DOUBLE AS fw FROM (
    SELECT *, x + (width - hw) / 2.0::DOUBLE AS hx, y::DOUBLE AS hy FROM (
     SELECT image_id, bx AS x, bye AS y, bw AS width, bh AS height, bh * 0.42::DOUBLE AS hh, bw * 0.58::DOUBLE AS hw FROM facts WHERE bw > 0 AND bh > 0)))))"""
I.CTES["regions"] = " UNION ALL ".join(
    f"SELECT image_id, '{s}' AS slot_id, '{side}' AS side, {fixed.DRAW_ORDER[s]} AS draw_order, CAST(round_even({x}, 0) AS INT) AS rx, CAST(round_even({y}, 0) AS INT) AS ry, "
    f"greatest(1, CAST(round_even({w}, 0) AS INT)) AS rw, greatest(1, CAST(round_even({h}, 0) AS INT)) AS rh FROM props"
    for s, side, x, y, w, h in ((s, side, *[re.sub(r"(\d+\.\d+)", r"\1::DOUBLE", t) for t in rest]) for s, side, *rest in BOXES))


@query("layout_regions", "image_id:l slot_id:s side:s x:l y:l width:l height:l",
       sql("SELECT image_id, slot_id, side, rx AS x, ry AS y, rw AS width, rh AS height FROM regions"))
def _(spark, d):
    return _regions(spark, d)


I.CTES["lmask"] = """
SELECT image_id, slot_id, side, draw_order, x, y FROM vpx JOIN facts USING (image_id) JOIN regions USING (image_id)
WHERE (opaque OR a > 31) AND x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh"""


def _layer_masks(spark, d) -> DataFrame:
    facts = _facts(spark, d)
    from ..operators import suitability as S

    subject = S.subject_mask(_varied(spark, d), facts).where("v > 0")
    masks = P.region_mask(subject, L.layout_regions(facts), ["slot_id", "side"])
    return masks.withColumn("draw_order", L._fixed_map(fixed.DRAW_ORDER)[F.col("slot_id")])


@query("assign_regions", "image_id:l slot_id:s pixels:l", sql("SELECT image_id, slot_id, count(*) AS pixels FROM lmask GROUP BY 1, 2"))
def _(spark, d):
    return _layer_masks(spark, d).groupBy("image_id", "slot_id").agg(F.count("*").alias("pixels"))


BOX_NAMES = {"left": "box_left", "top": "box_top", "right": "box_right", "bottom": "box_bottom"}
SLOTS_PLUS = [*[s for s, *_ in fixed.SLOTS], "tattoo"]
SIDES_SQL = "['none', 'left', 'right']"


def _proposals(spark, d) -> DataFrame:
    names = "array(" + ", ".join(f"'{s}'" for s in SLOTS_PLUS) + ")"
    return I.table(spark, d, "lineitem").selectExpr(
        "l_orderkey as image_id", f"element_at({names}, cast((l_partkey + l_linenumber) % 17 + 1 as int)) as slot_id",
        "element_at(array('none', 'left', 'right'), cast(l_suppkey % 3 + 1 as int)) as side", "cast(l_quantity as int) % 6 as coverage")


I.CTES["proposed"] = f"""
SELECT l_orderkey AS image_id, {SLOTS_PLUS}[(l_partkey + l_linenumber) % 17 + 1] AS slot_id, {SIDES_SQL}[l_suppkey % 3 + 1] AS side, CAST(l_quantity AS INT) % 6 AS coverage FROM lineitem"""
MAP_ORDER = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in fixed.DRAW_ORDER.items()) + "}"
MAP_NAME = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.DISPLAY_NAMES.items()) + "}"
I.CTES["decided"] = f"""
SELECT image_id, slot_id, side, 'layer.' || replace(slot_id, '.', '-') AS layer_id, {MAP_NAME}[slot_id] AS display_name, {MAP_ORDER}[slot_id] AS draw_order, 'LOW_CONFIDENCE' AS status,
  CASE WHEN slot_id = 'tattoo' THEN 'UNKNOWN_SLOT' WHEN (slot_id LIKE '%.left' AND side <> 'left') OR (slot_id LIKE '%.right' AND side <> 'right') THEN 'SIDE_CONFLICT' WHEN copies > 1 THEN 'DUPLICATE_SLOT' END AS problem
FROM (SELECT *, count(*) OVER (PARTITION BY image_id, slot_id) AS copies FROM proposed) WHERE coverage > 0 OR copies > 1"""


@query("decide_layers", "image_id:l slot_id:s side:s layer_id:s display_name:s draw_order:l status:s problem:s", sql("SELECT * FROM decided"))
def _(spark, d):
    return L.decide_layers(_proposals(spark, d), R.slots(spark))


@query("ontology_completion", "image_id:l slot_index:l slot_id:s status:s instance_id:s reason_code:s", sql(f"""
SELECT image_id, slot_index, slot_id, status, instance_id, CASE WHEN status = 'LOW_CONFIDENCE' THEN 'ONTOLOGY_SLOT_LOW_CONFIDENCE' END AS reason_code FROM (
  SELECT e.image_id, e.slot_index, e.slot_id, l.layer_id AS instance_id, CASE WHEN l.layer_id IS NOT NULL THEN l.status WHEN app = 'required' THEN 'LOW_CONFIDENCE' ELSE 'NOT_APPLICABLE' END AS status
  FROM (SELECT o_orderkey AS image_id, unnest(range(0, 16)) AS slot_index, unnest({[s for s, *_ in fixed.SLOTS]}) AS slot_id, unnest({[a for *_, a in fixed.SLOTS]}) AS app FROM orders) e
  LEFT JOIN (SELECT DISTINCT image_id, slot_id, layer_id, status FROM decided WHERE problem IS NULL) l USING (image_id, slot_id))"""))
def _(spark, d):
    images = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return L.ontology_completion(images, L.decide_layers(_proposals(spark, d), R.slots(spark)).where("problem is null"))


def _namespaced(spark, d) -> DataFrame:
    """Proposals as a registry with a namespace writes them; those of one side in nine lack it."""
    return _proposals(spark, d).withColumn("slot_id", F.expr("if(image_id % 9 = 0 and side = 'left', slot_id, concat('ns.', slot_id))"))


@query("namespaced_layers", "image_id:l slot_id:s side:s layer_id:s display_name:s draw_order:l problem:s", sql(f"""
SELECT image_id, slot_id, side, 'layer.' || replace(bare, '.', '-') AS layer_id, CASE WHEN named THEN {MAP_NAME}[bare] END AS display_name, CASE WHEN named THEN {MAP_ORDER}[bare] END AS draw_order,
  CASE WHEN NOT named OR bare = 'tattoo' THEN 'UNKNOWN_SLOT' WHEN (bare LIKE '%.left' AND side <> 'left') OR (bare LIKE '%.right' AND side <> 'right') THEN 'SIDE_CONFLICT' WHEN copies > 1 THEN 'DUPLICATE_SLOT' END AS problem
FROM (SELECT *, count(*) OVER (PARTITION BY image_id, slot_id) AS copies FROM (
  SELECT * EXCLUDE (slot_id), slot_id AS bare, NOT (image_id % 9 = 0 AND side = 'left') AS named, CASE WHEN image_id % 9 = 0 AND side = 'left' THEN slot_id ELSE 'ns.' || slot_id END AS slot_id FROM proposed)) WHERE coverage > 0 OR copies > 1"""))
def _(spark, d):
    return L.decide_layers(_namespaced(spark, d), R.slots(spark, "ns."), namespace="ns.")


@query("namespaced_completion", "image_id:l slot_index:l slot_id:s status:s instance_id:s reason_code:s", sql(f"""
SELECT image_id, slot_index, 'ns.' || slot_id AS slot_id, status, instance_id, CASE WHEN status = 'LOW_CONFIDENCE' THEN 'ONTOLOGY_SLOT_LOW_CONFIDENCE' END AS reason_code FROM (
  SELECT e.image_id, e.slot_index, e.slot_id, l.layer_id AS instance_id, CASE WHEN l.layer_id IS NOT NULL THEN l.status WHEN app = 'required' THEN 'LOW_CONFIDENCE' ELSE 'NOT_APPLICABLE' END AS status
  FROM (SELECT o_orderkey AS image_id, unnest(range(0, 16)) AS slot_index, unnest({[s for s, *_ in fixed.SLOTS]}) AS slot_id, unnest({[a for *_, a in fixed.SLOTS]}) AS app FROM orders) e
  LEFT JOIN (SELECT DISTINCT image_id, slot_id, layer_id, status FROM decided WHERE problem IS NULL) l USING (image_id, slot_id))"""))
def _(spark, d):
    images = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    proposals = _proposals(spark, d).withColumn("slot_id", F.concat(F.lit("ns."), "slot_id"))
    return L.ontology_completion(images, L.decide_layers(proposals, R.slots(spark, "ns."), namespace="ns.").where("problem is null"), "ns.")


PATCH_SQL = " UNION ALL ".join(
    f"SELECT image_id, '{p}' AS patch_id, {x0} * width // 100 AS l, {y0} * height // 100 AS t, least(width, ({x1} * width + 99) // 100) AS r, least(height, ({y1} * height + 99) // 100) AS b FROM img"
    for p, _, _, (x0, y0, x1, y1) in fixed.PATCHES)
I.CTES["patches"] = PATCH_SQL


@query("percent_patches", "image_id:l patch_id:s box_left:l box_top:l box_right:l box_bottom:l",
       sql("SELECT image_id, patch_id, l AS box_left, t AS box_top, r AS box_right, b AS box_bottom FROM patches"))
def _(spark, d):
    return L.percent_patches(I.images(spark, d)).withColumnsRenamed(BOX_NAMES)


def _motion_parts(spark, d) -> DataFrame:
    return parts(spark, d).withColumn("part", F.expr("if(part = 'eyewhite', 'eye', part)"))


def _canvas(spark, d) -> DataFrame:
    return I.table(spark, d, "supplier").selectExpr("s_suppkey as image_id", "16 as width", "16 as height")


I.CTES["pboxes"] = f"""
SELECT image_id, 'layer.' || replace(part, ' ', '-') || CASE WHEN part = 'eye' THEN '.character-' || side ELSE '' END AS layer_id, part, side,
  greatest(CASE WHEN part = 'eye' AND side = 'left' THEN 8 ELSE 0 END, l - 4) AS bl, greatest(0, t - 4) AS bt, least(CASE WHEN part = 'eye' AND side = 'right' THEN 8 ELSE 16 END, r + 4) AS br, least(16, b + 4) AS bb,
  CASE WHEN part = 'eye' THEN 'eye' WHEN part IN ({', '.join(f"'{p}'" for p in fixed.STATIC_PARTS)}) THEN 'static' WHEN part = 'mouth' THEN 'mouth' ELSE 'head' END AS motion_group
FROM (SELECT image_id, part, side, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM (
  SELECT image_id, x, y, CASE WHEN part = 'eyewhite' THEN 'eye' ELSE part END AS part, CASE WHEN part <> 'eyewhite' THEN 'not-applicable' WHEN x >= 8 THEN 'left' ELSE 'right' END AS side
  FROM parts WHERE a > 15 AND (image_id + x + y) % 3 = 0) GROUP BY 1, 2, 3)"""


def part_boxes(spark, d) -> DataFrame:
    return L.part_boxes(_motion_parts(spark, d).where("(image_id + x + y) % 3 = 0"), _canvas(spark, d))


@query("part_boxes", "image_id:l layer_id:s part:s side:s box_left:l box_top:l box_right:l box_bottom:l motion_group:s", sql("""
SELECT image_id, layer_id, part, side, bl AS box_left, bt AS box_top, br AS box_right, bb AS box_bottom, motion_group FROM pboxes"""))
def _(spark, d):
    return part_boxes(spark, d).withColumnsRenamed(BOX_NAMES)


@query("motion_lineage", "image_id:l layer_id:s operations:s binding_ids:s", sql("""
SELECT image_id, layer_id, 'alpha-clean,subject-matte,bbox-crop-padding-4' || CASE WHEN part = 'face' THEN ',deterministic-face-underpaint' ELSE '' END ||
  CASE WHEN part IN ('eye', 'eyebrow', 'nose', 'mouth') THEN ',source-visible-feature-rgb' ELSE '' END || CASE WHEN part = 'eye' THEN ',grouped-eye-mask' ELSE '' END AS operations,
  concat_ws(',', CASE WHEN motion_group <> 'static' THEN 'binding.head-yaw,binding.head-pitch' END, CASE WHEN motion_group = 'eye' AND side = 'left' THEN 'binding.eye-left-open' END,
    CASE WHEN motion_group = 'eye' AND side = 'right' THEN 'binding.eye-right-open' END, CASE WHEN motion_group = 'mouth' THEN 'binding.mouth-open' END) AS binding_ids FROM pboxes"""))
def _(spark, d):
    found = L.motion_lineage(part_boxes(spark, d))
    return found.withColumn("operations", F.array_join("operations", ",")).withColumn("binding_ids", F.array_join("binding_ids", ","))


@query("corner_fill", "image_id:l x:l y:l r:l g:l b:l a:l in_head:b cut_from_head:b", sql("""
SELECT image_id, x, y, CASE WHEN inh THEN mr ELSE r END AS r, CASE WHEN inh THEN mg ELSE g END AS g, CASE WHEN inh THEN mb ELSE b END AS b, CASE WHEN inh THEN ma ELSE a END AS a, inh AS in_head, inh AND child AS cut_from_head FROM (
  SELECT p.*, p.x >= h.l AND p.x < h.r AND p.y >= h.t AND p.y < h.b AS inh,
    EXISTS (SELECT 1 FROM patches c WHERE c.image_id = p.image_id AND c.patch_id <> 'head' AND p.x >= c.l AND p.x < c.r AND p.y >= c.t AND p.y < c.b) AS child, mr, mg, mb, ma
  FROM px p JOIN patches h ON h.image_id = p.image_id AND h.patch_id = 'head' JOIN (
    SELECT image_id, CAST(sum(r) AS BIGINT) // 4 AS mr, CAST(sum(g) AS BIGINT) // 4 AS mg, CAST(sum(b) AS BIGINT) // 4 AS mb, CAST(sum(a) AS BIGINT) // 4 AS ma
    FROM px JOIN img USING (image_id) WHERE (x = 0 OR x = width - 1) AND (y = 0 OR y = height - 1) GROUP BY 1) m ON m.image_id = p.image_id)"""))
def _(spark, d):
    return L.corner_fill(I.pixels(spark, d), I.images(spark, d))


@query("head_opaque_gate", "image_id:l lowest:l highest:l verdict:s", sql("""
SELECT image_id, lowest, highest, CASE WHEN width < 64 OR height < 64 THEN 'RASTER_DIMENSIONS_UNSUPPORTED' WHEN lowest = 255 AND highest = 255 THEN 'SUPPORTED' ELSE 'CANDIDATE_SUITABILITY_UNSUPPORTED' END AS verdict
FROM img JOIN (SELECT p.image_id, min(CASE WHEN p.image_id % 3 = 0 THEN 255 ELSE p.a END) AS lowest, max(CASE WHEN p.image_id % 3 = 0 THEN 255 ELSE p.a END) AS highest
  FROM px p JOIN patches h ON h.image_id = p.image_id AND h.patch_id = 'head' WHERE p.x >= h.l AND p.x < h.r AND p.y >= h.t AND p.y < h.b GROUP BY 1) USING (image_id)"""))
def _(spark, d):
    p = I.pixels(spark, d).withColumn("a", F.expr("if(image_id % 3 = 0, 255, a)"))
    return L.head_opaque_gate(p, I.images(spark, d))


# --- bounded completion -------------------------------------------------------------------------------------------

MARGIN_SQL = "CASE slot_id " + " ".join(f"WHEN '{s}' THEN {m}" for s, m in fixed.REVEAL_MARGINS.items()) + f" ELSE {fixed.DEFAULT_REVEAL_MARGIN} END"
I.CTES["grid"] = f"""
SELECT p.image_id, s.slot_id, p.x, p.y, {MARGIN_SQL.replace('slot_id', 's.slot_id')} AS margin, s.draw_order AS own, opaque OR p.a > 31 AS subject, CASE WHEN m.x IS NOT NULL THEN 1 ELSE 0 END AS visible
FROM vpx p JOIN facts USING (image_id) JOIN (SELECT DISTINCT image_id, slot_id, draw_order FROM lmask) s ON s.image_id = p.image_id
LEFT JOIN lmask m ON m.image_id = p.image_id AND m.slot_id = s.slot_id AND m.x = p.x AND m.y = p.y"""
I.CTES["reveal"] = """
SELECT image_id, slot_id, x, y, visible, CASE WHEN visible = 0 AND near = 1 AND subject AND coalesce(front > own, false) THEN 255 ELSE 0 END AS target FROM (
  SELECT *, max(rowhit) OVER (PARTITION BY image_id, slot_id, x ORDER BY y RANGE BETWEEN margin PRECEDING AND margin FOLLOWING) AS near FROM (
    SELECT *, max(visible) OVER (PARTITION BY image_id, slot_id, y ORDER BY x RANGE BETWEEN margin PRECEDING AND margin FOLLOWING) AS rowhit FROM grid))
LEFT JOIN (SELECT image_id, x, y, max(draw_order) AS front FROM lmask GROUP BY 1, 2, 3) USING (image_id, x, y)"""
I.CTES["softened"] = """
SELECT image_id, slot_id, x, y, visible, target, CASE WHEN visible = 1 THEN 0 ELSE least(target, f) END AS generated, CASE WHEN visible = 1 THEN 255 ELSE least(target, f) END AS coverage FROM (
  SELECT *, CAST(sum(h) OVER w AS BIGINT) // (count(*) OVER w) AS f FROM (
    SELECT *, CAST(sum(target) OVER v AS BIGINT) // (count(*) OVER v) AS h FROM reveal WINDOW v AS (PARTITION BY image_id, slot_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
  WINDOW w AS (PARTITION BY image_id, slot_id, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE visible = 1 OR target > 0"""


def _reveal(spark, d) -> DataFrame:
    masks = _layer_masks(spark, d)
    from ..operators import suitability as S

    subject = S.subject_mask(_varied(spark, d), _facts(spark, d))
    return L.reveal_target(masks, subject, I.images(spark, d))


def _softened(spark, d) -> DataFrame:
    return L.soften_generated(_reveal(spark, d), I.images(spark, d))


@query("reveal_target", "image_id:l slot_id:s x:l y:l visible:l target:l", sql("SELECT * FROM reveal WHERE visible = 1 OR target > 0"))
def _(spark, d):
    return _reveal(spark, d)


@query("soften_generated", "image_id:l slot_id:s x:l y:l visible:l target:l generated:l coverage:l", sql("SELECT * FROM softened"))
def _(spark, d):
    return _softened(spark, d)


@query("generated_regions", "image_id:l region_id:s owner_layer_id:s x:l y:l width:l height:l samples:l producer:s seed:s", sql("""
SELECT image_id, 'generated.' || replace(slot_id, '.', '-') AS region_id, 'layer.' || replace(slot_id, '.', '-') AS owner_layer_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height,
  count(*) FILTER (WHERE generated > 0) AS samples, 'edge-extension' AS producer,
  lpad(('0x' || substr(sha256('00000000000000000042' || chr(31) || 'PLAN_AND_BOUNDED_COMPLETE' || chr(31) || image_id), 1, 16))::UBIGINT::VARCHAR, 20, '0') AS seed
FROM softened GROUP BY image_id, slot_id HAVING max(target) > 0"""))
def _(spark, d):
    seed = D.derive_seed(F.lit("0" * 18 + "42"), F.lit("PLAN_AND_BOUNDED_COMPLETE"), F.col("image_id").cast("string"))
    return L.generated_regions(_softened(spark, d), seed, "0" * 64)


def layer_textures(source: DataFrame, softened: DataFrame) -> DataFrame:
    """Fill every layer's target from its nearest visible pixels and restore the source where the layer is visible."""
    keys = ["image_id", "slot_id"]
    soft = cut(softened)
    colours = source.select("image_id", "x", "y", "r", "g", "b")
    known = soft.where("visible = 1").select(*keys, "x", "y").join(colours, ["image_id", "x", "y"]).select(*keys, "x", "y", "r", "g", "b")
    target = soft.where("target > 0").select(*keys, "x", "y", F.col("target").alias("v"))
    filled = G.nearest_fill(known, target, keys)
    return L.soften_texture(filled, source, soft)


@query("layer_textures", "image_id:l slot_id:s x:l y:l r:l g:l b:l a:l", None)
def _(spark, d):
    return layer_textures(_varied(spark, d), _softened(spark, d))
