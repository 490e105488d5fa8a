"""Queries diagnosing reconstructions: coverage, omissions and their causes, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compose as C
from ..operators import fidelity as D
from ..operators import graph as G
from . import inputs as I
from .compose import PART_NAMES, parts
from .inputs import sql
from .registry import query

T = 31
I.CTES["fid"] = """
SELECT image_id, sv AS source_visible, rv AS reconstruction_visible, cov AS covered, sv - cov AS omitted, round(cov / sv, 6) AS coverage, round(ex / sv, 6) AS exact_ratio,
  round((dr / sv + dg / sv + db / sv) / 3, 6) AS mae, CASE WHEN sv = 0 THEN 'no_visible_pixels' WHEN cov = sv AND ex / sv >= 0.995 AND (dr / sv + dg / sv + db / sv) / 3 <= 0.5 THEN 'pass' ELSE 'review_required' END AS status
FROM (SELECT image_id, count(*) FILTER (WHERE s) AS sv, count(*) FILTER (WHERE r) AS rv, count(*) FILTER (WHERE s AND r) AS cov, count(*) FILTER (WHERE s AND d0 + d1 + d2 = 0) AS ex,
    sum(d0) FILTER (WHERE s) AS dr, sum(d1) FILTER (WHERE s) AS dg, sum(d2) FILTER (WHERE s) AS db
  FROM (SELECT s.image_id, s.a > 31 AS s, c.a > 31 AS r, abs(s.r - c.r) AS d0, abs(s.g - c.g) AS d1, abs(s.b - c.b) AS d2 FROM spx s JOIN recon c USING (image_id, x, y)) GROUP BY 1)"""
I.CTES["omit"] = """
SELECT image_id, x, y, s.a AS source_a, coalesce(union_a, 0) AS union_a, CASE WHEN coalesce(union_a, 0) = 0 THEN 'H2' WHEN union_a <= 31 THEN 'H1' ELSE 'invalid' END AS grp
FROM spx s LEFT JOIN uni USING (image_id, x, y) WHERE s.a > 31 AND coalesce(union_a, 0) <= 31"""


def _recon(spark, d) -> DataFrame:
    return C.reconstruct(parts(spark, d), I.source_pixels(spark, d))


def _fidelity(spark, d) -> DataFrame:
    return D.neutral_fidelity(I.source_pixels(spark, d), _recon(spark, d), T)


def _omitted(spark, d) -> DataFrame:
    return D.omitted_pixels(I.source_pixels(spark, d), _recon(spark, d), C.union_alpha(parts(spark, d)), T)


def _images(spark, d) -> DataFrame:
    return I.table(spark, d, "supplier").selectExpr("s_suppkey as image_id", "16 as width", "16 as height")


@query("neutral_fidelity", "image_id:l source_visible:l reconstruction_visible:l covered:l omitted:l coverage:d exact_ratio:d mae:d status:s", sql("SELECT * FROM fid"))
def _(spark, d):
    return _fidelity(spark, d)


@query("omission_split", "image_id:l grp:s pixels:l bin0:l bin1:l bin2:l bin3:l bin4:l median:d", sql("""
SELECT image_id, grp, count(*) AS pixels, count(*) FILTER (WHERE source_a BETWEEN 32 AND 63) AS bin0, count(*) FILTER (WHERE source_a BETWEEN 64 AND 127) AS bin1,
  count(*) FILTER (WHERE source_a BETWEEN 128 AND 191) AS bin2, count(*) FILTER (WHERE source_a BETWEEN 192 AND 254) AS bin3, count(*) FILTER (WHERE source_a = 255) AS bin4, median(source_a) AS median
FROM omit GROUP BY 1, 2"""))
def _(spark, d):
    return D.omission_split(_omitted(spark, d), T)


I.CTES["hist"] = """
SELECT image_id, union_a, coalesce(n, 0) AS n FROM (SELECT s_suppkey AS image_id, unnest(range(0, 32)) AS union_a FROM supplier)
LEFT JOIN (SELECT image_id, union_a, count(*) AS n FROM omit GROUP BY 1, 2) USING (image_id, union_a)"""


@query("union_histogram", "image_id:l union_a:l n:l", sql("SELECT * FROM hist"))
def _(spark, d):
    return D.union_histogram(_omitted(spark, d), _images(spark, d), T)


@query("argmax_parts", "image_id:l part:s pixels:l ties:l", sql(f"""
SELECT image_id, part, coalesce(pixels, 0) AS pixels, coalesce(ties, 0) AS ties FROM (SELECT s_suppkey AS image_id, unnest({list(PART_NAMES)}) AS part, unnest(range(1, 8)) AS part_index FROM supplier)
LEFT JOIN (SELECT image_id, part_index, count(*) AS pixels, count(*) FILTER (WHERE reached > 1) AS ties FROM (
  SELECT image_id, x, y, min(part_index) AS part_index, count(*) AS reached FROM parts JOIN omit USING (image_id, x, y) WHERE grp = 'H1' AND a = union_a GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (image_id, part_index)"""))
def _(spark, d):
    found = D.argmax_parts(_omitted(spark, d), parts(spark, d))
    names = "array(" + ", ".join(f"'{p}'" for p in PART_NAMES) + ")"
    every = _images(spark, d).select("image_id", F.posexplode(F.expr(names)).alias("p", "part")).withColumn("part_index", F.col("p") + 1)
    return every.join(found, ["image_id", "part_index"], "left").na.fill(0, ["pixels", "ties"])


@query("alpha_preimages", "image_id:l union_a:l preimages:s", sql("""
SELECT image_id, union_a, array_to_string(list_filter(range(32, 256), lambda v: round_even((v - 31) * 255 / 224, 0) = union_a), ',') AS preimages FROM hist WHERE union_a > 0 AND n > 0"""))
def _(spark, d):
    found = D.alpha_preimages(D.union_histogram(_omitted(spark, d), _images(spark, d), T), T)
    return found.withColumn("preimages", F.array_join(F.col("preimages").cast("array<string>"), ","))


@query("coverage_projection", "image_id:l numerator:l denominator:l ratio:d coverage_passes:b exact_passes:b mae_passes:b all_pass:b", sql("""
SELECT image_id, covered + coalesce(h1, 0) AS numerator, source_visible AS denominator, round((covered + coalesce(h1, 0)) / source_visible, 6) AS ratio, covered + coalesce(h1, 0) >= source_visible AS coverage_passes,
  exact_ratio >= 0.995 AS exact_passes, mae <= 0.5 AS mae_passes, covered + coalesce(h1, 0) >= source_visible AND exact_ratio >= 0.995 AND mae <= 0.5 AS all_pass
FROM fid LEFT JOIN (SELECT image_id, count(*) AS h1 FROM omit WHERE grp = 'H1' GROUP BY 1) USING (image_id)"""))
def _(spark, d):
    h1 = _omitted(spark, d).where("grp = 'H1'").groupBy("image_id").agg(F.count("*").alias("pixels"))
    return D.coverage_projection(_fidelity(spark, d), h1)


@query("stored_metric_mismatches", "image_id:l metric:s", sql("""
SELECT image_id, unnest(list_filter([CASE WHEN image_id % 5 = 0 THEN 'covered' END, CASE WHEN image_id % 7 = 0 THEN 'mae' END], lambda m: m IS NOT NULL)) AS metric FROM fid"""))
def _(spark, d):
    now = _fidelity(spark, d)
    stored = now.withColumn("covered", F.expr("covered + if(image_id % 5 = 0, 1, 0)")).withColumn("mae", F.expr("if(image_id % 7 = 0, null, mae)"))
    return D.stored_metric_mismatches(stored, now, ["image_id"], ["source_visible", "covered", "omitted", "mae"])


@query("review_items", "image_id:l items:l warned:b", sql("SELECT image_id, CASE WHEN status = 'pass' THEN 3 ELSE 4 END AS items, status <> 'pass' AS warned FROM fid"))
def _(spark, d):
    found = D.review_items(_fidelity(spark, d))
    return found.select("image_id", F.size("items").alias("items"), F.element_at("items", -1).startswith("FIDELITY_GATE_NOT_PASSED").alias("warned"))


# --- graphs -----------------------------------------------------------------------------------------------------------

# Flood by label propagation in SQL: every cell takes the smallest label among itself and its four neighbours.
def _flood(cells: str) -> str:
    return f"""
WITH RECURSIVE cells AS ({cells}), flood(image_id, x, y, sx, sy) USING KEY (image_id, x, y) AS (
  SELECT image_id, x, y, x AS sx, y AS sy FROM cells UNION
  SELECT c.image_id, c.x, c.y, min(f.sx + f.sy * 100000) % 100000, min(f.sx + f.sy * 100000) // 100000
  FROM flood f JOIN cells c ON c.image_id = f.image_id AND ((abs(c.x - f.x) = 1 AND c.y = f.y) OR (c.x = f.x AND abs(c.y - f.y) = 1))
  JOIN recurring.flood k ON k.image_id = c.image_id AND k.x = c.x AND k.y = c.y GROUP BY c.image_id, c.x, c.y
  HAVING min(f.sx + f.sy * 100000) < min(k.sx + k.sy * 100000))"""


def _visible(spark, d) -> DataFrame:
    """Two groups of cells with long connected shapes: visible pixels, tagged H1 when green is even."""
    return I.pixels(spark, d).where("a > 60").select("image_id", "x", "y", F.when(F.col("g") % 2 == 0, "H1").otherwise("H2").alias("grp"))


@query("components4", "image_id:l components:l median_size:d largest:l largest_y:l largest_x:l h1:l h2:l dominant:s composition:s",
       _flood(sql("SELECT image_id, x, y FROM px WHERE a > 60")) + """,
sizes AS (SELECT image_id, sx, sy, count(*) AS n, count(*) FILTER (WHERE (5 * y + x) % 256 % 2 = 0) AS h1 FROM flood GROUP BY 1, 2, 3),
top AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, sy, sx) = 1)
SELECT s.image_id, count(*) AS components, median(s.n) AS median_size, max(s.n) AS largest, any_value(t.sy) AS largest_y, any_value(t.sx) AS largest_x, any_value(t.h1) AS h1, any_value(t.n - t.h1) AS h2,
  any_value(CASE WHEN t.h1 = t.n - t.h1 THEN 'tie' WHEN t.h1 > t.n - t.h1 THEN 'H1' ELSE 'H2' END) AS dominant, any_value(CASE WHEN t.h1 > 0 AND t.n > t.h1 THEN 'mixed' ELSE 'single_group' END) AS composition
FROM sizes s JOIN top t USING (image_id) GROUP BY 1""")
def _(spark, d):
    from ..session import cut

    labelled = cut(G.components4(_visible(spark, d), ["image_id"]))
    facts = G.component_facts(labelled, ["image_id"])
    return facts.join(G.largest_composition(labelled, facts), "image_id").withColumn("largest_y", F.expr("largest_start div 4294967296")).withColumn(
        "largest_x", F.expr("largest_start % 4294967296"))


@query("components4_by_group", "image_id:l grp:s components:l largest:l", None)
def _(spark, d):
    labelled = G.components4(_visible(spark, d), ["image_id", "grp"])
    return G.component_facts(labelled, ["image_id", "grp"])


def _matted(spark, d) -> DataFrame:
    return I.pixels(spark, d).withColumn("a", F.expr("if(x between 12 and 50 and y between 8 and 56 and a > 0, 255, a)"))


I.CTES["matted"] = "SELECT image_id, x, y, r, g, b, CASE WHEN x BETWEEN 12 AND 50 AND y BETWEEN 8 AND 56 AND a > 0 THEN 255 ELSE a END AS a FROM px"


@query("subject_matte", "image_id:l x:l y:l v:l", _flood(sql("SELECT image_id, x, y FROM matted WHERE a < 248")) + f""",
cells_all AS ({sql("SELECT m.image_id, x, y, width, height FROM matted m JOIN img USING (image_id)")}),
hit AS (SELECT DISTINCT f.image_id, sx, sy FROM flood f JOIN cells_all c USING (image_id, x, y) WHERE x = 0 OR y = 0 OR x = width - 1 OR y = height - 1),
ext AS (SELECT f.image_id, f.x, f.y FROM flood f JOIN hit USING (image_id, sx, sy)),
near AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM ext, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy))
SELECT c.image_id, c.x, c.y, CASE WHEN n.x IS NULL THEN 255 ELSE 0 END AS v FROM cells_all c LEFT JOIN near n USING (image_id, x, y)""")
def _(spark, d):
    return G.subject_matte(_matted(spark, d), I.images(spark, d))


@query("fill_holes", "image_id:l x:l y:l r:l g:l b:l a:l painted:b", _flood(sql("SELECT image_id, x, y FROM matted WHERE a <= 15")) + f""",
base AS ({sql("SELECT image_id, x, y, r, g, b, a FROM matted")}),
outer_cells AS (SELECT f.image_id, f.x, f.y FROM flood f JOIN (SELECT image_id, sx, sy FROM flood WHERE x = 0 AND y = 0) USING (image_id, sx, sy)),
holes AS (SELECT image_id, x, y FROM base WHERE a <= 15 EXCEPT SELECT image_id, x, y FROM outer_cells),
near AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM holes, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
means AS (SELECT image_id, round_even(avg(r), 0) AS mr, round_even(avg(g), 0) AS mg, round_even(avg(b), 0) AS mb FROM base WHERE a >= 240 GROUP BY 1)
SELECT b.image_id, b.x, b.y, CASE WHEN n.x IS NOT NULL THEN mr ELSE r END AS r, CASE WHEN n.x IS NOT NULL THEN mg ELSE g END AS g, CASE WHEN n.x IS NOT NULL THEN mb ELSE b.b END AS b,
  CASE WHEN n.x IS NOT NULL THEN 255 ELSE a END AS a, n.x IS NOT NULL AS painted FROM base b LEFT JOIN near n USING (image_id, x, y) JOIN means USING (image_id)""")
def _(spark, d):
    return G.fill_holes(_matted(spark, d))


@query("nearest_fill", "image_id:l x:l y:l r:l g:l b:l a:l level:l", None)
def _(spark, d):
    p = I.pixels(spark, d)
    known = p.where("a > 200")
    target = p.where("a <= 200").select("image_id", "x", "y", F.greatest(F.col("a"), F.lit(1)).alias("v"))
    return G.nearest_fill(known, target, ["image_id"])


@query("parent_chain", "node:l problem:s", sql("""
WITH RECURSIVE tree AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 101 = 0 THEN p_partkey * 2 WHEN p_partkey % 331 = 0 THEN p_partkey + 100000000 ELSE p_partkey // 2 END AS parent FROM part),
walk AS (SELECT node, parent AS anc, 1 AS depth FROM tree UNION ALL SELECT w.node, t.parent, depth + 1 FROM walk w JOIN tree t ON t.node = w.anc WHERE depth < 80)
SELECT node, 'PARENT_MISSING' AS problem FROM tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM tree) UNION ALL
SELECT node, 'CYCLE' FROM walk WHERE depth = 80 AND anc IS NOT NULL"""))
def _(spark, d):
    nodes = I.table(spark, d, "part").selectExpr(
        "p_partkey as node", "case when p_partkey = 0 then null when p_partkey % 101 = 0 then p_partkey * 2 when p_partkey % 331 = 0 then p_partkey + 100000000 else p_partkey div 2 end as parent")
    return G.parent_chain(nodes)


@query("occlusion_cycles", "project_id:l missing_node:l self_edges:l cyclic:b", sql("""
WITH RECURSIVE e AS (SELECT l_orderkey AS p, l_linenumber AS b, 1 + l_partkey % 7 AS f FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS node FROM lineitem),
ok AS (SELECT DISTINCT e.p, b, f FROM e JOIN n ON n.p = e.p AND n.node = e.f WHERE b <> f),
reach AS (SELECT p, b AS s, f AS t FROM ok UNION SELECT r.p, r.s, ok.f FROM reach r JOIN ok ON ok.p = r.p AND ok.b = r.t),
cyc AS (SELECT DISTINCT p FROM reach WHERE s = t)
SELECT e.p AS project_id, count(*) FILTER (WHERE n.node IS NULL) AS missing_node, count(*) FILTER (WHERE n.node IS NOT NULL AND e.b = e.f) AS self_edges, bool_or(cyc.p IS NOT NULL) AS cyclic
FROM e LEFT JOIN n ON n.p = e.p AND n.node = e.f LEFT JOIN cyc ON cyc.p = e.p GROUP BY 1"""))
def _(spark, d):
    lines = I.table(spark, d, "lineitem")
    edges = lines.selectExpr("l_orderkey as project_id", "cast(l_linenumber as bigint) as behind", "1 + l_partkey % 7 as front")
    nodes = lines.selectExpr("l_orderkey as project_id", "cast(l_linenumber as bigint) as node")
    return G.occlusion_errors(nodes, edges, ["project_id"])
