"""Queries over meshes, parameters, bindings, poses, frame sequences and warping.

Every supplier's seven layers become meshes over the layers' boxes; sequences are seeded by customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests as D
from ..functions import fixed
from ..operators import motion as M
from ..session import cut
from . import inputs as I
from .inputs import sql
from .layers import part_boxes
from .registry import query

SLOTS = ("face.base", "eye.left", "eye.right", "mouth", "torso", "hair.front", "hair.back")
SLOT_OF = "element_at(array(" + ", ".join(f"'{s}'" for s in SLOTS) + "), cast(draw_order as int))"


def _layers(spark, d) -> DataFrame:
    return I.layer_pixels(spark, d).where("a > 0").withColumn("slot_id", F.expr(SLOT_OF))


def _boxes(spark, d) -> DataFrame:
    box = _layers(spark, d).groupBy("image_id", "slot_id", "draw_order").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    return box.withColumn("canvas_width", F.lit(16)).withColumn("canvas_height", F.lit(16))


I.CTES["mboxes"] = f"""
SELECT image_id, {list(SLOTS)}[draw_order] AS slot_id, draw_order, min(x) AS bx, min(y) AS bye, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh,
  CASE draw_order WHEN 1 THEN 6 WHEN 5 THEN 6 WHEN 6 THEN 5 WHEN 7 THEN 5 ELSE 4 END AS cols, CASE draw_order WHEN 1 THEN 6 WHEN 5 THEN 6 WHEN 6 THEN 4 WHEN 7 THEN 5 ELSE 3 END AS rws
FROM lpx WHERE a > 0 GROUP BY 1, 2, 3"""
I.CTES["mverts"] = """
SELECT image_id, slot_id, r * (cols + 1) + c AS vi, (bx + bw * c / cols)::FLOAT::DOUBLE AS x, (bye + bh * r / rws)::FLOAT::DOUBLE AS y,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bx + bw * c / cols) / 16))::FLOAT::DOUBLE AS u, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bye + bh * r / rws) / 16))::FLOAT::DOUBLE AS v
FROM (SELECT *, unnest(range(0, cols + 1)) AS c FROM (SELECT *, unnest(range(0, rws + 1)) AS r FROM mboxes))"""
I.CTES["mtris"] = """
SELECT image_id, slot_id, cell * 2 + k AS ti, tl AS a, CASE k WHEN 0 THEN tl + 1 ELSE tl + cols + 2 END AS b, CASE k WHEN 0 THEN tl + cols + 2 ELSE tl + cols + 1 END AS c
FROM (SELECT *, cell // cols * (cols + 1) + cell % cols AS tl, unnest([0, 1]) AS k FROM (SELECT *, unnest(range(0, rws * cols)) AS cell FROM mboxes))"""


@query("grid_vertices", "image_id:l slot_id:s vi:l x:d y:d u:d v:d", sql("SELECT * FROM mverts"))
def _(spark, d):
    return M.grid_vertices(_boxes(spark, d))


@query("grid_triangles", "image_id:l slot_id:s ti:l a:l b:l c:l", sql("SELECT * FROM mtris"))
def _(spark, d):
    return M.grid_triangles(_boxes(spark, d))


I.CTES["bverts"] = "SELECT image_id, slot_id, vi, CASE WHEN image_id % 7 = 0 AND vi = 8 THEN x + 9 ELSE x END AS x, y, CASE WHEN image_id % 5 = 0 AND vi = 3 THEN u + 1 ELSE u END AS u, v FROM mverts"
I.CTES["btris"] = """
SELECT image_id, slot_id, ti, a, b, CASE WHEN image_id % 11 = 0 AND ti = 5 THEN 999 WHEN image_id % 13 = 0 AND ti = 4 THEN a ELSE c END AS c FROM mtris UNION ALL
SELECT image_id, slot_id, 1000 + ti, c, a, b FROM mtris WHERE image_id % 9 = 0 AND ti < 2"""
I.CTES["bjoin"] = """
SELECT t.*, (vb.x - va.x) * (vc.y - va.y) - (vc.x - va.x) * (vb.y - va.y) AS area, va.x IS NULL OR vb.x IS NULL OR vc.x IS NULL AS bad FROM btris t
LEFT JOIN bverts va ON va.image_id = t.image_id AND va.slot_id = t.slot_id AND va.vi = t.a LEFT JOIN bverts vb ON vb.image_id = t.image_id AND vb.slot_id = t.slot_id AND vb.vi = t.b
LEFT JOIN bverts vc ON vc.image_id = t.image_id AND vc.slot_id = t.slot_id AND vc.vi = t.c"""


@query("mesh_checks", "image_id:l slot_id:s vertices:l triangles:l bad_index:l repeated_index:l degenerate:l reversed:l duplicates:l bad_uv:l", sql("""
SELECT * FROM (SELECT image_id, slot_id, count(*) AS vertices, count(*) FILTER (WHERE u > 1) AS bad_uv FROM bverts GROUP BY 1, 2)
JOIN (SELECT image_id, slot_id, count(*) AS triangles, count(*) FILTER (WHERE bad) AS bad_index, count(*) FILTER (WHERE a = b OR b = c OR a = c) AS repeated_index, count(*) FILTER (WHERE area = 0) AS degenerate,
  count(*) FILTER (WHERE area < 0) AS reversed, count(*) - count(DISTINCT list_sort([a, b, c])) AS duplicates FROM bjoin GROUP BY 1, 2) USING (image_id, slot_id)"""))
def _(spark, d):
    boxes = _boxes(spark, d)
    vertices = M.grid_vertices(boxes).withColumn("x", F.expr("if(image_id % 7 = 0 and vi = 8, x + 9, x)")).withColumn("u", F.expr("if(image_id % 5 = 0 and vi = 3, u + 1, u)"))
    triangles = M.grid_triangles(boxes)
    copies = triangles.where("image_id % 9 = 0 and ti < 2").selectExpr("image_id", "slot_id", "1000 + ti as ti", "c as a", "a as b", "b as c")
    broken = triangles.withColumn("c", F.expr("case when image_id % 11 = 0 and ti = 5 then 999 when image_id % 13 = 0 and ti = 4 then a else c end"))
    return M.mesh_checks(vertices, broken.unionByName(copies))


@query("resolve_parameters", "part_id:l minimum:d maximum:d default_value:d safe_minimum:d safe_maximum:d", sql("""
SELECT p_partkey AS part_id, p_size - 5 AS minimum, p_size + 5 AS maximum, p_size + off AS default_value,
  round(least(p_size - 5 + 10 * (1.0::DOUBLE - 0.8::DOUBLE) / 2, p_size + off), 9) + 0.0 AS safe_minimum, round(greatest(p_size + 5 - 10 * (1.0::DOUBLE - 0.8::DOUBLE) / 2, p_size + off), 9) + 0.0 AS safe_maximum
FROM (SELECT *, p_partkey % 11 - 5 AS off FROM part)"""))
def _(spark, d):
    registry = I.table(spark, d, "part").selectExpr("p_partkey as part_id", "cast(p_size - 5 as double) as low", "cast(p_size + 5 as double) as high", "cast(p_size + p_partkey % 11 - 5 as double) as neutral")
    return M.resolve_parameters(registry).withColumn("safe_minimum", F.expr("round(safe_minimum, 9) + 0.0D")).withColumn("safe_maximum", F.expr("round(safe_maximum, 9) + 0.0D"))


def _parameters(spark, d) -> DataFrame:
    """The resolved registry for every image; the registry's ten rows travel as an array literal."""
    rows = F.array(*[F.struct(F.lit(p).alias("parameter_id"), F.lit(cap).alias("capability"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(n).alias("neutral"))
                     for p, cap, lo, hi, n, _ in fixed.PARAMETERS])
    per_image = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.inline(rows))
    return M.resolve_parameters(per_image)


I.CTES["mparams"] = """
SELECT s_suppkey AS image_id, idx, parameter_id, capability, low AS mn, high AS mx, neutral AS df, least(low + (high - low) * (1.0::DOUBLE - 0.8::DOUBLE) / 2, neutral) AS smn, greatest(high - (high - low) * (1.0::DOUBLE - 0.8::DOUBLE) / 2, neutral) AS smx
FROM supplier CROSS JOIN preg"""
BRIDGE = ", ".join(f"('{p}', '{s}')" for p, slots in fixed.PARAMETER_SLOTS.items() for s in slots)
I.CTES["msamp"] = f"""
SELECT image_id, slot_id, parameter_id, idx, sv, vi,
  CASE parameter_id WHEN 'head.yaw' THEN n * w * 0.06::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(y - cy) / (h / 2)) * 0.35::DOUBLE) WHEN 'eye.gaze.x' THEN n * w * 0.10::DOUBLE
    WHEN 'mouth.form' THEN (x - cx) / (w / 2) * n * w * 0.06::DOUBLE WHEN 'body.lean' THEN n * w * 0.05::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (y - bye) / h) ELSE 0.0::DOUBLE END AS dx,
  CASE parameter_id WHEN 'head.pitch' THEN -n * h * 0.05::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(x - cx) / (w / 2)) * 0.25::DOUBLE) WHEN 'eye.gaze.y' THEN -n * h * 0.10::DOUBLE
    WHEN 'breath' THEN -n * h * 0.012::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (y - bye) / h) WHEN 'eye.left.open' THEN (cy - y) * pull WHEN 'eye.right.open' THEN (cy - y) * pull WHEN 'mouth.open' THEN (cy - y) * pull ELSE 0.0::DOUBLE END AS dy
FROM (SELECT *, sv / greatest(abs(mn), abs(mx)) AS n, greatest(-0.92::DOUBLE, least(0.92::DOUBLE, (df - sv) / (mx - mn))) AS pull, bx + w / 2 AS cx, bye + h / 2 AS cy FROM (
  SELECT p.*, b.slot_id, b.bx, b.bye, b.bw::DOUBLE AS w, b.bh::DOUBLE AS h, unnest(list_distinct([mn, df, mx])) AS sv FROM mparams p
  JOIN (VALUES {BRIDGE}) br(pid, sid) ON br.pid = p.parameter_id JOIN mboxes b ON b.image_id = p.image_id AND b.slot_id = br.sid)) JOIN mverts USING (image_id, slot_id)"""


def _samples(spark, d) -> DataFrame:
    boxes = _boxes(spark, d)
    return M.generate_bindings(M.grid_vertices(boxes), boxes, _parameters(spark, d))


@query("generate_bindings", "image_id:l slot_id:s parameter_id:s sample_value:d vi:l dx:d dy:d", sql("""
SELECT image_id, slot_id, parameter_id, sv AS sample_value, vi, round(dx, 9) + 0.0 AS dx, round(dy, 9) + 0.0 AS dy FROM msamp"""))
def _(spark, d):
    return _samples(spark, d).withColumn("dx", F.expr("round(dx, 9) + 0.0D")).withColumn("dy", F.expr("round(dy, 9) + 0.0D"))


@query("missing_mandatory_bindings", "image_id:l parameter_id:s", sql("""
SELECT s_suppkey AS image_id, parameter_id FROM supplier CROSS JOIN preg WHERE capability = 'candidate_mandatory' AND NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey % 150 = idx)"""))
def _(spark, d):
    names = "array(" + ", ".join(f"'{p}'" for p, *_ in fixed.PARAMETERS) + ")"
    bindings = I.table(spark, d, "lineitem").where("l_partkey % 150 < 10").selectExpr("l_suppkey as image_id", f"element_at({names}, cast(l_partkey % 150 + 1 as int)) as parameter_id")
    return M.missing_mandatory(_parameters(spark, d), bindings)


@query("sample_order_check", "binding_id:l samples:l not_increasing:l wrong_count:l", sql("""
SELECT binding_id, count(*) AS samples, count(*) FILTER (WHERE val <= before) AS not_increasing, count(*) FILTER (WHERE n IS DISTINCT FROM vc) AS wrong_count
FROM (SELECT *, lag(val) OVER (PARTITION BY binding_id ORDER BY i) AS before FROM (
  SELECT l_orderkey AS binding_id, l_linenumber * 100000 + l_partkey AS i, l_quantity AS val, l_suppkey % 4 AS n, vc FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS l_quantity, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT o_orderkey, o_custkey % 4 AS vc FROM orders) ON o_orderkey = l_orderkey))
GROUP BY 1 HAVING count(*) < 2 OR not_increasing > 0 OR wrong_count > 0"""))
def _(spark, d):
    lines = I.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_quantity").alias("q"), F.min("l_suppkey").alias("s"))
    samples = lines.selectExpr("l_orderkey as binding_id", "l_orderkey as mesh_id", "l_linenumber * 100000 + l_partkey as sample_index", "q as sample_value", "s % 4 as delta_count")
    counts = I.table(spark, d, "orders").selectExpr("o_orderkey as mesh_id", "o_custkey % 4 as vertex_count")
    return M.sample_order_errors(samples, counts)


I.CTES["mposes"] = """
SELECT p.image_id, pose, parameter_id, idx, CASE WHEN moved = parameter_id THEN CASE WHEN ends_with(pose, '.min') THEN mn ELSE mx END WHEN moved IS NOT NULL OR pose = 'neutral' OR capability <> 'candidate_mandatory' THEN df
  WHEN pose = 'combination.mandatory-min' THEN mn WHEN pose = 'combination.mandatory-max' THEN mx ELSE smn + (smx - smn) * (right(pose, 2)::INT / 11) END AS value
FROM mparams p JOIN (SELECT s_suppkey AS image_id, unnest(list_concat(['neutral', 'combination.mandatory-min', 'combination.mandatory-max'], list_transform(range(0, 12), lambda i: 'trajectory.' || lpad(i::VARCHAR, 2, '0')))) AS pose, NULL AS moved FROM supplier UNION ALL
  SELECT image_id, parameter_id || '.' || unnest(['min', 'max']), parameter_id FROM mparams) q ON q.image_id = p.image_id"""


@query("pose_set", "image_id:l pose:s parameter_id:s value:d", sql("""
SELECT image_id, pose, parameter_id, round(value, 9) AS value FROM mposes"""))
def _(spark, d):
    return M.pose_set(_parameters(spark, d)).withColumn("value", F.round("value", 9))


I.CTES["minterp"] = """
SELECT q.image_id, q.slot_id, q.parameter_id, q.idx, q.pose, q.vi,
  CASE WHEN lo IS NULL THEN hdx WHEN hi IS NULL THEN ldx WHEN hi = value AND top = value THEN hdx ELSE ldx + (hdx - ldx) * ((value - lo) / (hi - lo)) END AS dx,
  CASE WHEN lo IS NULL THEN hdy WHEN hi IS NULL THEN ldy WHEN hi = value AND top = value THEN hdy ELSE ldy + (hdy - ldy) * ((value - lo) / (hi - lo)) END AS dy
FROM (SELECT s.image_id, s.slot_id, s.parameter_id, s.idx, p.pose, p.value, s.vi, max(sv) AS top, max(sv) FILTER (WHERE sv < value) AS lo, min(sv) FILTER (WHERE sv >= value) AS hi,
    arg_max(dx, sv) FILTER (WHERE sv < value) AS ldx, arg_max(dy, sv) FILTER (WHERE sv < value) AS ldy, arg_min(dx, sv) FILTER (WHERE sv >= value) AS hdx, arg_min(dy, sv) FILTER (WHERE sv >= value) AS hdy
  FROM msamp s JOIN mposes p ON p.image_id = s.image_id AND p.parameter_id = s.parameter_id GROUP BY 1, 2, 3, 4, 5, 6, 7) q"""


@query("interpolate_deltas", "image_id:l slot_id:s parameter_id:s pose:s vertices:l dx:d dy:d", sql("""
SELECT image_id, slot_id, parameter_id, pose, count(*) AS vertices, round(sum(dx), 6) + 0.0 AS dx, round(sum(dy), 6) + 0.0 AS dy FROM minterp GROUP BY 1, 2, 3, 4"""))
def _(spark, d):
    binding = ["image_id", "parameter_id", "slot_id"]
    samples = _samples(spark, d)
    wanted = samples.select(*binding).distinct().join(M.pose_set(_parameters(spark, d)), ["image_id", "parameter_id"]).select(*binding, "pose", "value")
    found = M.interpolate(samples.select(*binding, "sample_value", "vi", "dx", "dy"), wanted, binding)
    return found.groupBy("image_id", "slot_id", "parameter_id", "pose").agg(
        F.count("*").alias("vertices"), F.expr("round(sum(dx), 6) + 0.0D").alias("dx"), F.expr("round(sum(dy), 6) + 0.0D").alias("dy"))


I.CTES["mposed"] = """
SELECT v.image_id, v.slot_id, q.pose, v.vi, v.x + coalesce(dx, 0) AS x, v.y + coalesce(dy, 0) AS y, u, v.v FROM mverts v JOIN (SELECT DISTINCT image_id, pose FROM mposes) q ON q.image_id = v.image_id
LEFT JOIN (SELECT image_id, slot_id, pose, vi, list_sum(list(dx ORDER BY idx)) AS dx, list_sum(list(dy ORDER BY idx)) AS dy FROM minterp GROUP BY 1, 2, 3, 4) t ON t.image_id = v.image_id AND t.slot_id = v.slot_id AND t.pose = q.pose AND t.vi = v.vi"""


def _posed(spark, d, poses: DataFrame) -> DataFrame:
    return M.pose_vertices(M.grid_vertices(_boxes(spark, d)), _samples(spark, d), poses)


@query("pose_vertices", "image_id:l slot_id:s pose:s vertices:l x:d y:d", sql("""
SELECT image_id, slot_id, pose, count(*) AS vertices, round(sum(x), 5) AS x, round(sum(y), 5) AS y FROM mposed GROUP BY 1, 2, 3"""))
def _(spark, d):
    posed = _posed(spark, d, M.pose_set(_parameters(spark, d)))
    return posed.groupBy("image_id", "slot_id", "pose").agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 5).alias("x"), F.round(F.sum("y"), 5).alias("y"))


# --- sequences ------------------------------------------------------------------------------------------------------

DOMAIN = "celstack.waypoint.v1"


def _frames(spark, d) -> DataFrame:
    seeds = I.spread(I.table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("run_id"), D.u64_from_hash(F.sha2(F.col("c_custkey").cast("string"), 256)).alias("seed"))
    return M.frame_sequence(seeds, DOMAIN)


I.CTES["cseeds"] = "SELECT c_custkey AS run_id, substr(sha256(c_custkey::VARCHAR), 1, 16) AS hexseed FROM customer"
I.CTES["wps"] = f"""
SELECT run_id, o, list(lo + 4 * (raw % ((hi - lo) // 4 + 1)::UBIGINT)::INT ORDER BY k) AS t FROM (
  SELECT run_id, o, k, lo, hi, ('0x' || substr(sha256('{DOMAIN}'::BLOB || '\\x00'::BLOB || unhex(hexseed) || unhex(printf('%04X00', o)) || encode(name)), 1, 16))::UBIGINT AS raw
  FROM cseeds CROSS JOIN (SELECT unnest(range(1, 6)) AS o), (VALUES {', '.join(f"({i}, '{p}', {lo}, {hi})" for i, (p, lo, hi) in enumerate(fixed.SEQUENCE_PARAMETERS))}) prm(k, name, lo, hi)) GROUP BY 1, 2"""
NEUTRAL_SQL = str(list(fixed.MANDATORY_FRAMES[0][1]))
I.CTES["fseq"] = f"""
SELECT run_id, idx, frame_id, source, t FROM (SELECT run_id, f.idx, f.frame_id, 'mandatory' AS source, f.t FROM cseeds CROSS JOIN (VALUES {', '.join(f"({i}, '{n}', {list(t)})" for i, (n, t) in enumerate(fixed.MANDATORY_FRAMES))}) f(idx, frame_id, t)) UNION ALL
SELECT run_id, 12, 'trajectory.000', 'seeded-trajectory', {NEUTRAL_SQL} FROM cseeds UNION ALL
SELECT run_id, 12 + o * 4 + s, printf('trajectory.%03d', o * 4 + s), 'seeded-trajectory', list_transform(range(1, 6), lambda i: CAST(floor((a[i] * (4 - s) + b[i] * s) / 4) AS INT)) FROM (
  SELECT run_id, o, t AS a, lead(t) OVER (PARTITION BY run_id ORDER BY o) AS b, unnest([1, 2, 3, 4]) AS s FROM (SELECT run_id, o, t FROM wps UNION ALL SELECT run_id, unnest([0, 6]), {NEUTRAL_SQL} FROM cseeds)) WHERE b IS NOT NULL"""


@query("frame_sequence", "run_id:l idx:l frame_id:s source:s ticks:s", sql("SELECT run_id, idx, frame_id, source, array_to_string(t, ',') AS ticks FROM fseq"))
def _(spark, d):
    return _frames(spark, d).withColumn("ticks", F.array_join(F.col("ticks").cast("array<string>"), ","))


@query("frames_vs_report", "run_id:l idx:l reported:s expected:s", sql("""
SELECT run_id, idx, CASE WHEN (run_id + idx) % 83 <> 0 THEN frame_id || CASE WHEN (run_id * 3 + idx) % 97 = 0 THEN '?' ELSE '' END END AS reported, frame_id AS expected
FROM fseq WHERE (run_id + idx) % 83 = 0 OR (run_id * 3 + idx) % 97 = 0"""))
def _(spark, d):
    from ..operators import package as K

    frames = _frames(spark, d)
    report = frames.where("(run_id + idx) % 83 <> 0").selectExpr("run_id", "idx", "concat(frame_id, if((run_id * 3 + idx) % 97 = 0, '?', '')) as frame_id")
    return K.frames_disagreeing(report, frames)


@query("neutral_frames_agree", "run_id:l frames:l agree:b", sql(f"""
SELECT run_id, count(*) AS frames, count(DISTINCT sha256(CASE WHEN run_id % 6 = 0 THEN frame_id ELSE '' END)) = 1 AS agree FROM fseq WHERE t = {NEUTRAL_SQL} GROUP BY 1"""))
def _(spark, d):
    neutral = F.col("ticks") == F.array(*[F.lit(t) for t in fixed.MANDATORY_FRAMES[0][1]])
    frames = _frames(spark, d).withColumn("is_neutral", neutral).withColumn("sha256", F.expr("sha2(if(run_id % 6 = 0, frame_id, ''), 256)"))
    return M.neutral_frames_agree(frames)


def _run_parts(spark, d) -> DataFrame:
    """Part boxes of every supplier image; the run is the customer with the same key."""
    sized = part_boxes(spark, d).withColumn("width", F.lit(16)).withColumn("height", F.lit(16))
    return sized.withColumnRenamed("image_id", "run_id")


PIVOT = "(SELECT image_id, (min(bt) + max(bb)) / 2 AS hp FROM pboxes WHERE motion_group <> 'static' GROUP BY 1)"
I.CTES["aff"] = f"""
SELECT run_id, layer_id, idx, bl, bt, br, bb, 1.0::DOUBLE AS a, CASE WHEN st THEN 0 ELSE hb * sc END AS b, CASE WHEN st THEN 0 ELSE hb * ((1 - sc) * pv) + hc END AS c, 0.0::DOUBLE AS d, CASE WHEN st THEN 1 ELSE sc END AS e, CASE WHEN st THEN 0 ELSE (1 - sc) * pv + hf END AS f
FROM (SELECT *, CASE motion_group WHEN 'eye' THEN 0.05::DOUBLE + 0.95::DOUBLE * CASE WHEN side = 'left' THEN t[3] / 1000 ELSE t[4] / 1000 END WHEN 'mouth' THEN 1.0::DOUBLE + 0.5::DOUBLE * (t[5] / 1000) ELSE 1.0::DOUBLE END AS sc,
    (16 / 50.0::DOUBLE) * (t[1] / 1000 / 15) - hb * hp AS hc, -(16 / 64.0::DOUBLE) * (t[2] / 1000 / 10) AS hf, (bt + bb) / 2 AS pv, motion_group = 'static' AS st
  FROM (SELECT p.*, f.run_id, f.idx, f.t, hp, 0.03::DOUBLE * (f.t[1] / 1000 / 15) AS hb FROM pboxes p JOIN {PIVOT} v USING (image_id) JOIN fseq f ON f.run_id = p.image_id))"""


@query("part_affine", "run_id:l layer_id:s idx:l a:d b:d c:d d:d e:d f:d", sql("""
SELECT run_id, layer_id, idx, a, round(b, 12) + 0.0 AS b, round(c, 12) + 0.0 AS c, d, round(e, 12) AS e, round(f, 12) + 0.0 AS f FROM aff"""))
def _(spark, d):
    found = M.part_affine(_run_parts(spark, d), _frames(spark, d))
    for c in "bcef":
        found = found.withColumn(c, F.expr(f"round({c}, 12) + 0.0D"))
    return found


@query("foldover_check", "run_id:l samples:l folded:l minimum_area2:d", sql("""
SELECT run_id, count(*) AS samples, count(*) FILTER (WHERE area <= 0) AS folded, round(min(area), 6) AS minimum_area2 FROM (
  SELECT run_id, (x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4) AS area FROM (
    SELECT run_id, a * bl + b * bt + c AS x1, d * bl + e * bt + f AS y1, a * br + b * bt + c AS x2, d * br + e * bt + f AS y2, a * br + b * bb + c AS x3, d * br + e * bb + f AS y3, a * bl + b * bb + c AS x4, d * bl + e * bb + f AS y4 FROM aff)) GROUP BY 1"""))
def _(spark, d):
    return M.foldover_check(M.part_affine(_run_parts(spark, d), _frames(spark, d))).withColumn("minimum_area2", F.round("minimum_area2", 6))


# --- warping --------------------------------------------------------------------------------------------------------

def _warped(spark, d):
    poses = M.pose_set(_parameters(spark, d))
    boxes = cut(_boxes(spark, d))
    vertices = cut(M.pose_vertices(M.grid_vertices(boxes), M.generate_bindings(M.grid_vertices(boxes), boxes, _parameters(spark, d)), poses))
    layers = boxes.select("image_id", "slot_id", "draw_order", F.expr("if(draw_order = 6, 0.5D, 1.0D)").alias("opacity"), F.lit(16).alias("width"), F.lit(16).alias("height"))
    textures = _layers(spark, d).select("image_id", "slot_id", "x", "y", "r", "g", "b", "a")
    return M.warp_rasters(vertices, M.grid_triangles(boxes), textures, layers), poses, vertices


# Warping has no SQL twin: a second implementation in the tests renders a small fixture pixel by pixel.
@query("warp_rasters", "image_id:l pose:s x:l y:l r:l g:l b:l a:l", None)
def _(spark, d):
    return _warped(spark, d)[0]


@query("pose_coverage", "image_id:l pose:s visible:l neutral_visible:l off_range:l status:s", None)
def _(spark, d):
    rendered, poses, vertices = _warped(spark, d)
    return M.pose_coverage(rendered, poses, vertices)
