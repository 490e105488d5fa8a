"""Queries over layered pixels: compositing, winners, provenance partitions, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import compose as C
from ..session import cut
from . import inputs as I
from .inputs import sql
from .registry import query

PART_NAMES = ("back hair", "topwear", "face", "eyewhite", "eyebrow", "mouth", "front hair")
PART_RANKS = tuple(fixed.PART_PRIORITY.index(p) for p in PART_NAMES)


def parts(spark, d) -> DataFrame:
    """Seven model parts per image with depths; the part is the layer's draw order."""
    names = "array(" + ", ".join(f"'{p}'" for p in PART_NAMES) + ")"
    ranks = "array(" + ", ".join(map(str, PART_RANKS)) + ")"
    return I.layer_pixels(spark, d).selectExpr(
        "image_id", "x", "y", f"element_at({names}, cast(draw_order as int)) as part", f"element_at({ranks}, cast(draw_order as int)) as priority",
        "draw_order as part_index", "r", "g", "b", "a", "depth")


I.CTES["parts"] = f"""
SELECT image_id, x, y, [{', '.join(f"'{p}'" for p in PART_NAMES)}][draw_order] AS part, {list(PART_RANKS)}[draw_order] AS priority, draw_order AS part_index, r, g, b, a, depth FROM lpx"""
S_OVER = "((s & 255) * (255 - (t & 255)))"
A_OUT = f"((t & 255) + ({S_OVER} + 127) // 255)"
MIX = " | ".join(
    f"(least(255, (((t >> {k}) & 255) * (t & 255) * 255 + ((s >> {k}) & 255) * {S_OVER}) // ({A_OUT} * 255)) << {k})" for k in (24, 16, 8))
I.CTES["comp"] = f"""
SELECT image_id, x, y, (c >> 24) & 255 AS r, (c >> 16) & 255 AS g, (c >> 8) & 255 AS b, c & 255 AS a FROM (
  SELECT image_id, x, y, list_reduce(list_prepend(0::BIGINT, list(e ORDER BY e)), lambda s, t: CASE WHEN t & 255 = 255 THEN t & 4294967295 ELSE {MIX} | {A_OUT} END) AS c
  FROM (SELECT image_id, x, y, draw_order * 4294967296 + ((r * 256 + g) * 256 + b) * 256 + a AS e FROM lpx WHERE a > 0) GROUP BY 1, 2, 3)"""


@query("composite_over", "image_id:l x:l y:l r:l g:l b:l a:l", sql("SELECT image_id, x, y, r, g, b, a FROM comp"))
def _(spark, d):
    return C.composite_over(I.layer_pixels(spark, d))


I.CTES["compties"] = I.CTES["comp"].replace("list(e ORDER BY e)", "list(e ORDER BY e // 4294967296 // 2, e)")


@query("composite_over_ties", "image_id:l x:l y:l r:l g:l b:l a:l", sql("SELECT image_id, x, y, r, g, b, a FROM compties"))
def _(spark, d):
    """Two layers share each draw order; both paint, in the order of their rank."""
    return C.composite_over(I.layer_pixels(spark, d).withColumns({"layer_rank": F.col("draw_order"), "draw_order": F.expr("draw_order div 2")}))


@query("occluder_union", "image_id:l x:l y:l draw_order:l v:l", sql("""
SELECT t.image_id, t.x, t.y, t.draw_order, CASE WHEN f.front > t.draw_order THEN 255 ELSE 0 END AS v
FROM (SELECT image_id, x, y, unnest([1, 3, 5, 7]) AS draw_order FROM spx) t
LEFT JOIN (SELECT image_id, x, y, max(draw_order) AS front FROM lpx WHERE a > 0 GROUP BY 1, 2, 3) f USING (image_id, x, y)"""))
def _(spark, d):
    targets = I.source_pixels(spark, d).select("image_id", "x", "y", F.explode(F.expr("array(1, 3, 5, 7)")).alias("draw_order"))
    return C.occluder_union(I.layer_pixels(spark, d), targets)


@query("source_protection", "image_id:l visible:l deviating:l worst:l", sql("""
SELECT image_id, count(*) AS visible, count(*) FILTER (WHERE delta > 0) AS deviating, max(delta) AS worst FROM (
  SELECT s.image_id, greatest(abs(s.r - coalesce(c.r, 0)), abs(s.g - coalesce(c.g, 0)), abs(s.b - coalesce(c.b, 0))) AS delta
  FROM spx s LEFT JOIN comp c USING (image_id, x, y) WHERE s.a > 31) GROUP BY 1"""))
def _(spark, d):
    return C.source_protection(I.layer_pixels(spark, d), I.source_pixels(spark, d))


@query("generated_exposure", "image_id:l owner_order:l exposed:l", sql("""
SELECT image_id, draw_order AS owner_order, count(*) AS exposed FROM lpx g JOIN spx s USING (image_id, x, y)
WHERE g.b % 4 = 0 AND s.a > 31 AND NOT EXISTS (SELECT 1 FROM lpx f WHERE f.image_id = g.image_id AND f.x = g.x AND f.y = g.y AND f.draw_order > g.draw_order AND f.a > 31) GROUP BY 1, 2"""))
def _(spark, d):
    layers = I.layer_pixels(spark, d)
    generated = layers.select("image_id", "x", "y", F.col("draw_order").alias("owner_order"), F.when(F.col("b") % 4 == 0, 255).otherwise(0).alias("v"))
    return C.generated_exposure(generated, layers, I.source_pixels(spark, d))


I.CTES["winner"] = """
SELECT image_id, x, y, priority AS winner, depth AS winner_depth FROM parts WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY depth, priority DESC) = 1"""


@query("front_winner", "image_id:l x:l y:l winner:l winner_depth:l", sql("SELECT * FROM winner"))
def _(spark, d):
    return C.front_winner(parts(spark, d))


@query("preserve_source", "image_id:l x:l y:l part:s r:l g:l b:l a:l", sql("""
SELECT image_id, x, y, part, CASE WHEN take THEN sr ELSE r END AS r, CASE WHEN take THEN sg ELSE g END AS g, CASE WHEN take THEN sb ELSE b END AS b, a FROM (
  SELECT p.*, coalesce(p.priority = w.winner AND s.a > 31, false) AS take, s.r AS sr, s.g AS sg, s.b AS sb
  FROM parts p LEFT JOIN winner w USING (image_id, x, y) LEFT JOIN spx s USING (image_id, x, y))"""))
def _(spark, d):
    return C.preserve_source(parts(spark, d), I.source_pixels(spark, d))


I.CTES["uni"] = "SELECT image_id, x, y, max(a) AS union_a FROM parts GROUP BY 1, 2, 3"
I.CTES["recon"] = """
SELECT image_id, x, y, CASE WHEN u > 0 THEN r ELSE 0 END AS r, CASE WHEN u > 0 THEN g ELSE 0 END AS g, CASE WHEN u > 0 THEN b ELSE 0 END AS b, u AS a
FROM (SELECT s.*, coalesce(union_a, 0) AS u FROM spx s LEFT JOIN uni USING (image_id, x, y))"""


@query("reconstruct_union", "image_id:l x:l y:l r:l g:l b:l a:l", sql("SELECT * FROM recon"))
def _(spark, d):
    return C.reconstruct(parts(spark, d), I.source_pixels(spark, d))


@query("hidden_masks", "image_id:l x:l y:l part:s", sql("""
SELECT image_id, x, y, part FROM parts JOIN winner USING (image_id, x, y) WHERE a > 0 AND priority <> winner"""))
def _(spark, d):
    return C.hidden_masks(parts(spark, d))


@query("source_partition", "image_id:l protected:l exposed:l omission:l union_pixels:l complete:b", sql("""
SELECT image_id, count(*) FILTER (WHERE u > 0 AND a > 31) AS protected, count(*) FILTER (WHERE u > 0 AND a <= 31) AS exposed,
  count(*) FILTER (WHERE u = 0 AND a > 31) AS omission, count(*) FILTER (WHERE u > 0) AS union_pixels, true AS complete
FROM (SELECT s.image_id, s.a, coalesce(union_a, 0) AS u FROM spx s LEFT JOIN uni USING (image_id, x, y)) GROUP BY 1"""))
def _(spark, d):
    p = parts(spark, d)
    return C.partition_check(C.source_partition(p, I.source_pixels(spark, d)), p)


@query("visible_rgb_mismatch", "image_id:l visible_mismatches:l reconstruction_mismatches:l alpha_mismatches:l", sql("""
SELECT image_id, count(*) FILTER (WHERE s.a > 31 AND w.r IS NOT NULL AND (w.r, w.g, w.b) <> (s.r, s.g, s.b)) AS visible_mismatches,
  count(*) FILTER (WHERE coalesce(union_a, 0) > 0 AND (c.r IS NULL OR (c.r, c.g, c.b) <> (s.r, s.g, s.b))) AS reconstruction_mismatches,
  count(*) FILTER (WHERE coalesce(c.a, 0) <> coalesce(union_a, 0)) AS alpha_mismatches
FROM spx s LEFT JOIN (SELECT p.* FROM parts p JOIN winner USING (image_id, x, y) WHERE priority = winner) w USING (image_id, x, y)
  LEFT JOIN comp c USING (image_id, x, y) LEFT JOIN uni USING (image_id, x, y) GROUP BY 1"""))
def _(spark, d):
    return C.visible_rgb_mismatch(parts(spark, d), I.source_pixels(spark, d), C.composite_over(I.layer_pixels(spark, d)))


@query("composite_vs_neutral", "image_id:l worst:l deviating:l", sql("""
SELECT image_id, max(delta) AS worst, count(*) FILTER (WHERE delta > 0) AS deviating FROM (
  SELECT coalesce(c.image_id, r.image_id) AS image_id, greatest(abs(coalesce(c.r, 0) - coalesce(r.r, 0)), abs(coalesce(c.g, 0) - coalesce(r.g, 0)), abs(coalesce(c.b, 0) - coalesce(r.b, 0)), abs(coalesce(c.a, 0) - coalesce(r.a, 0))) AS delta
  FROM comp c FULL JOIN recon r ON c.image_id = r.image_id AND c.x = r.x AND c.y = r.y) GROUP BY 1"""))
def _(spark, d):
    return C.composite_delta(C.composite_over(I.layer_pixels(spark, d)), C.reconstruct(parts(spark, d), I.source_pixels(spark, d)))


@query("neutral_compare", "image_id:l visible:l exact_ratio:d mae:d", sql("""
SELECT image_id, count(*) AS visible, round(count(*) FILTER (WHERE dr + dg + db = 0) / count(*), 6) AS exact_ratio, round((sum(dr) / count(*) + sum(dg) / count(*) + sum(db) / count(*)) / 3, 6) AS mae
FROM (SELECT s.image_id, abs(s.r - coalesce(c.r, 0)) AS dr, abs(s.g - coalesce(c.g, 0)) AS dg, abs(s.b - coalesce(c.b, 0)) AS db FROM spx s LEFT JOIN recon c USING (image_id, x, y) WHERE s.a > 15) GROUP BY 1"""))
def _(spark, d):
    s = I.source_pixels(spark, d)
    return C.neutral_compare(s, C.reconstruct(parts(spark, d), s))


NAMES = list(fixed.DISPLAY_NAMES.values())
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
SOURCE, FILL, README = "Source Reference", "Generated Fill: ", "Read Me"
I.CTES["plin"] = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2"
I.CTES["panel"] = f"""
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY band, draw_order, is_layer, tie) AS position, name, visible, locked, opacity FROM (
  SELECT o_orderkey AS project_id, 0 AS band, 0 AS draw_order, 0 AS is_layer, '' AS tie, '{SOURCE}' AS name, false AS visible, true AS locked, 255 AS opacity FROM orders UNION ALL
  SELECT o_orderkey, 2, 0, 0, '', '{README}', false, false, 255 FROM orders UNION ALL
  SELECT l_orderkey, 1, l_linenumber * 50, 1, 'layer.' || l_linenumber, {NAMES_SQL}[l_linenumber], p % 5 <> 0, false, round_even(q / 50 * 255, 0) FROM plin UNION ALL
  SELECT l_orderkey, 1, l_linenumber * 50, 0, 'region.' || l_linenumber, '{FILL}' || {NAMES_SQL}[l_linenumber], true, false, 255 FROM plin WHERE p % 3 = 0)"""


def _panel(spark, d) -> DataFrame:
    names = "array(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
    lines = I.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    projects = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"))
    layers = lines.selectExpr("l_orderkey as project_id", "concat('layer.', l_linenumber) as layer_id", "l_linenumber * 50 as draw_order",
                              f"element_at({names}, cast(l_linenumber as int)) as display_name", "p % 5 <> 0 as visible", "q / 50 as opacity")
    regions = lines.where("p % 3 = 0").selectExpr("l_orderkey as project_id", "concat('region.', l_linenumber) as region_id", "concat('layer.', l_linenumber) as owner_layer_id")
    return C.panel_projection(projects, layers, regions, SOURCE, FILL, README)


@query("panel_projection", "project_id:l position:l name:s visible:b locked:b opacity:l", sql("SELECT * FROM panel"))
def _(spark, d):
    return _panel(spark, d)


I.CTES["actual"] = """
SELECT project_id, CASE WHEN project_id % 10 = 0 AND position IN (2, 3) THEN 5 - position ELSE position END AS position, name, visible,
    CASE WHEN project_id % 17 = 0 AND position = 4 THEN 7 ELSE opacity END AS opacity, locked AND project_id % 23 <> 0 AS locked, CASE WHEN project_id % 29 = 0 THEN 'mul' ELSE 'norm' END AS blend
  FROM panel WHERE NOT (project_id % 31 = 0 AND position = 5)"""
I.CTES["joined_panels"] = """
SELECT coalesce(e.project_id, a.project_id) AS project_id, coalesce(e.position, a.position) AS position, e.name AS en, e.visible AS ev, e.opacity AS eo, e.locked AS el, a.name, a.visible, a.opacity, a.locked, a.blend
  FROM panel e FULL JOIN actual a ON e.project_id = a.project_id AND e.position = a.position"""


@query("panel_check", "project_id:l position:l reason:s", sql(f"""
SELECT project_id, position, reason FROM (SELECT j.project_id, j.position, CASE WHEN en IS NULL OR j.name IS NULL THEN 'LAYER_COUNT' WHEN j.name <> en THEN 'ORDER' WHEN j.visible <> ev THEN 'VISIBILITY'
   WHEN j.opacity <> eo THEN 'OPACITY' WHEN j.locked <> el THEN 'LOCK' WHEN j.blend <> 'norm' THEN 'BLEND' WHEN j.position = 1 AND (j.name <> '{SOURCE}' OR j.visible OR NOT j.locked) THEN 'SOURCE_NOT_FIRST'
   WHEN j.position = top AND j.name <> '{README}' THEN 'READ_ME_NOT_LAST'
   WHEN starts_with(j.name, '{FILL}') AND u.name IS DISTINCT FROM substr(j.name, {len(FILL) + 1}) THEN 'FILL_NOT_UNDER_OWNER' END AS reason
 FROM joined_panels j LEFT JOIN actual u ON u.project_id = j.project_id AND u.position = j.position + 1
   LEFT JOIN (SELECT project_id, max(position) AS top FROM actual GROUP BY 1) t ON t.project_id = j.project_id) WHERE reason IS NOT NULL"""))
def _(spark, d):
    expected = cut(_panel(spark, d))  # read four times below
    actual = expected.where("not (project_id % 31 = 0 and position = 5)").selectExpr(
        "project_id", "if(project_id % 10 = 0 and position in (2, 3), 5 - position, position) as position", "name", "visible",
        "if(project_id % 17 = 0 and position = 4, 7, opacity) as opacity", "locked and project_id % 23 <> 0 as locked", "if(project_id % 29 = 0, 'mul', 'norm') as blend")
    return C.panel_check(expected, actual, SOURCE, FILL, README)


@query("fill_pixels", "image_id:l x:l y:l r:l g:l b:l a:l", sql("""
SELECT image_id, x, y, r, g, b, least(a, coalesce(v, 0)) AS a FROM px LEFT JOIN mask_b USING (image_id, x, y)"""))
def _(spark, d):
    return C.fill_pixels(I.pixels(spark, d), I.shifted_mask(spark, d))


def _canvas(spark, d) -> DataFrame:
    return I.table(spark, d, "supplier").selectExpr("s_suppkey as image_id", "16 as width", "16 as height")


SLOT_COUNTS = " UNION ALL ".join(
    f"SELECT image_id, '{slot}' AS slot_id, '{app}' AS applicability, count(*) FILTER (WHERE bits & {C.slot_bits(slot)} <> 0"
    + {"left": " AND x >= 8", "right": " AND x < 8"}.get(side, "") + ") AS pixels FROM partbits GROUP BY 1"
    for slot, _, side, _, app in fixed.SLOTS)
I.CTES["partbits"] = "SELECT s_suppkey AS image_id, x, y, coalesce(bits, 0) AS bits FROM supplier LEFT JOIN (SELECT image_id, x, y, bit_or(1 << priority) AS bits FROM parts WHERE a > 0 GROUP BY 1, 2, 3) ON image_id = s_suppkey"
I.CTES["partslots"] = f"SELECT *, CASE WHEN pixels > 0 THEN 'PRESENT' WHEN applicability = 'required' THEN 'LOW_CONFIDENCE' ELSE 'NOT_APPLICABLE' END AS status FROM ({SLOT_COUNTS})"


@query("ontology_from_parts", "image_id:l slot_id:s applicability:s pixels:l status:s", sql("SELECT * FROM partslots"))
def _(spark, d):
    return C.ontology_from_parts(parts(spark, d), _canvas(spark, d))


@query("required_slot_facts", "image_id:l present:l required:l", sql("""
SELECT image_id, count(*) FILTER (WHERE status = 'PRESENT') AS present, count(*) AS required FROM partslots WHERE applicability = 'required' GROUP BY 1"""))
def _(spark, d):
    return C.required_slot_facts(C.ontology_from_parts(parts(spark, d), _canvas(spark, d)))
