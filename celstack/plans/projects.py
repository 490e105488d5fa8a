"""Queries over project documents, artifacts, packages and inventories.

A project is an order, its layers are the order's lines, artifacts are parts and documents. Broken references,
duplicate ids and wrong roles come from arithmetic on the keys, so they occur at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import integrity as G
from ..operators import package as K
from ..sources import registries as R
from . import inputs as I
from .inputs import sql
from .registry import query


def _lines(spark, d) -> DataFrame:
    return I.table(spark, d, "lineitem")


def _projects(spark, d) -> DataFrame:
    return I.table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"))


def _entities(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    layers = lines.selectExpr("l_orderkey as project_id", "'layers' as kind", "concat('e.', l_linenumber) as id")
    meshes = lines.where("l_linenumber <= 4").selectExpr(
        "l_orderkey as project_id", "'meshes' as kind", "concat(if(l_partkey % 97 = 0, 'e.', 'm.'), l_linenumber) as id")
    bindings = lines.where("l_quantity > 25").selectExpr(
        "l_orderkey as project_id", "'bindings' as kind", "concat('b.', l_linenumber, '.', l_partkey % 5) as id")
    return layers.unionByName(meshes).unionByName(bindings)


I.CTES["ent"] = """
SELECT l_orderkey AS project_id, 'layers' AS kind, 'e.' || l_linenumber AS id FROM lineitem UNION ALL
SELECT l_orderkey, 'meshes', CASE WHEN l_partkey % 97 = 0 THEN 'e.' ELSE 'm.' END || l_linenumber FROM lineitem WHERE l_linenumber <= 4 UNION ALL
SELECT l_orderkey, 'bindings', 'b.' || l_linenumber || '.' || l_partkey % 5 FROM lineitem WHERE l_quantity > 25"""


@query("duplicate_ids", "project_id:l kind:s id:s copies:l",
       sql("SELECT project_id, kind, id, count(*) AS copies FROM ent GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def _(spark, d):
    return G.duplicate_ids(_entities(spark, d))


@query("cross_kind_collisions", "project_id:l id:s uses:l across_kinds:b", sql("""
SELECT project_id, id, count(*) AS uses, count(DISTINCT kind) > 1 AS across_kinds FROM ent GROUP BY 1, 2 HAVING count(*) > 1"""))
def _(spark, d):
    return G.cross_kind_collisions(_entities(spark, d))


def _artifacts(spark, d) -> DataFrame:
    """Artifacts each project declares: its parts, except every 17th part."""
    parts = I.table(spark, d, "part").where("p_partkey % 17 <> 0").selectExpr("p_partkey as l_partkey", "p_size")
    role = F.expr("element_at(array('source', 'layer_texture', 'layer_texture', 'generated_mask', 'mesh_delta'), p_size % 5 + 1)")
    return _lines(spark, d).select("l_orderkey", "l_partkey").join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("project_id"), F.expr("concat('a.', l_partkey)").alias("artifact_id"), role.alias("role"))


I.CTES["art"] = """
SELECT l_orderkey AS project_id, 'a.' || l_partkey AS artifact_id,
  ['source', 'layer_texture', 'layer_texture', 'generated_mask', 'mesh_delta'][p_size % 5 + 1] AS role
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 17 <> 0"""


def _edges(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    texture = lines.selectExpr("l_orderkey as project_id", "'layer-texture' as edge", "concat('e.', l_linenumber) as owner_id", "concat('a.', l_partkey) as target_id")
    mesh = lines.where("l_linenumber <= 4").selectExpr(
        "l_orderkey as project_id", "'mesh-layer' as edge", "concat('m.', l_linenumber) as owner_id",
        "concat('e.', l_linenumber + if(l_partkey % 11 = 0, 3, 0)) as target_id")
    parameter = lines.where("l_quantity > 25").selectExpr(
        "l_orderkey as project_id", "'binding-parameter' as edge", "concat('b.', l_linenumber) as owner_id", "concat('p.', l_suppkey % 13) as target_id")
    fact = lines.where("l_discount > 0.05").selectExpr(
        "l_orderkey as project_id", "'fact-target' as edge", "concat('f.', l_linenumber) as owner_id",
        "concat(if(l_partkey % 2 = 0, 'e.', 'm.'), l_linenumber) as target_id")
    return texture.unionByName(mesh).unionByName(parameter).unionByName(fact)


def _targets(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    textures = _artifacts(spark, d).selectExpr("project_id", "'layer-texture' as edge", "artifact_id as id")
    layers = lines.selectExpr("l_orderkey as project_id", "'mesh-layer' as edge", "concat('e.', l_linenumber) as id")
    parameters = lines.selectExpr("l_orderkey as project_id", "'binding-parameter' as edge", "concat('p.', l_suppkey % 10) as id")
    fact_layers = layers.withColumn("edge", F.lit("fact-target"))
    fact_meshes = lines.where("l_linenumber <= 4").selectExpr("l_orderkey as project_id", "'fact-target' as edge", "concat('m.', l_linenumber) as id")
    return textures.unionByName(layers).unionByName(parameters).unionByName(fact_layers).unionByName(fact_meshes)


I.CTES["edges"] = """
SELECT l_orderkey AS project_id, 'layer-texture' AS edge, 'e.' || l_linenumber AS owner_id, 'a.' || l_partkey AS target_id FROM lineitem UNION ALL
SELECT l_orderkey, 'mesh-layer', 'm.' || l_linenumber, 'e.' || (l_linenumber + CASE WHEN l_partkey % 11 = 0 THEN 3 ELSE 0 END) FROM lineitem WHERE l_linenumber <= 4 UNION ALL
SELECT l_orderkey, 'binding-parameter', 'b.' || l_linenumber, 'p.' || l_suppkey % 13 FROM lineitem WHERE l_quantity > 25 UNION ALL
SELECT l_orderkey, 'fact-target', 'f.' || l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'e.' ELSE 'm.' END || l_linenumber FROM lineitem WHERE l_discount > 0.05"""
I.CTES["targets"] = """
SELECT project_id, 'layer-texture' AS edge, artifact_id AS id FROM art UNION ALL
SELECT l_orderkey, 'mesh-layer', 'e.' || l_linenumber FROM lineitem UNION ALL
SELECT l_orderkey, 'binding-parameter', 'p.' || l_suppkey % 10 FROM lineitem UNION ALL
SELECT l_orderkey, 'fact-target', 'e.' || l_linenumber FROM lineitem UNION ALL
SELECT l_orderkey, 'fact-target', 'm.' || l_linenumber FROM lineitem WHERE l_linenumber <= 4"""


@query("unresolved_references", "project_id:l edge:s owner_id:s target_id:s", sql("""
SELECT * FROM edges e WHERE NOT EXISTS (
  SELECT 1 FROM targets t WHERE t.project_id = e.project_id AND t.edge = e.edge AND t.id = e.target_id)"""))
def _(spark, d):
    return G.unresolved_references(_edges(spark, d), _targets(spark, d))


@query("wrong_roles", "project_id:l owner_id:s artifact_id:s expected_role:s role:s", sql("""
SELECT project_id, owner_id, artifact_id, expected_role, role FROM (
  SELECT l_orderkey AS project_id, 'e.' || l_linenumber AS owner_id, 'a.' || l_partkey AS artifact_id, 'layer_texture' AS expected_role FROM lineitem UNION ALL
  SELECT l_orderkey, 'g.' || l_linenumber, 'a.' || l_partkey, 'generated_mask' FROM lineitem WHERE l_tax > 0.06)
JOIN (SELECT DISTINCT * FROM art) USING (project_id, artifact_id)
WHERE role <> expected_role AND NOT (role = 'source' AND expected_role = 'layer_texture')"""))
def _(spark, d):
    lines = _lines(spark, d)
    textures = lines.selectExpr("l_orderkey as project_id", "concat('e.', l_linenumber) as owner_id", "concat('a.', l_partkey) as artifact_id", "'layer_texture' as expected_role")
    masks = lines.where("l_tax > 0.06").selectExpr("l_orderkey as project_id", "concat('g.', l_linenumber) as owner_id", "concat('a.', l_partkey) as artifact_id", "'generated_mask' as expected_role")
    return G.wrong_roles(textures.unionByName(masks), _artifacts(spark, d))


@query("draw_order_clashes", "project_id:l layers:l distinct_orders:l", sql("""
SELECT l_orderkey AS project_id, count(*) AS layers, count(DISTINCT l_linenumber) AS distinct_orders
FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber)"""))
def _(spark, d):
    return G.draw_order_clashes(_lines(spark, d).selectExpr("l_orderkey as project_id", "l_linenumber as draw_order"))


@query("artifact_verify", "payload_key:l id:s reason:s", sql("""
SELECT payload_key, id, CASE WHEN content IS NULL THEN 'BYTES_MISSING' WHEN sha256(content) <> sha THEN 'DIGEST_MISMATCH'
    WHEN strlen(content) <> len THEN 'LENGTH_MISMATCH' WHEN id <> 'sha256:' || sha THEN 'NOT_CONTENT_ADDRESS' END AS reason
FROM (SELECT doc_id AS payload_key, CASE WHEN doc_id % 29 <> 0 THEN text END AS content,
        CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha,
        strlen(text) + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS len,
        CASE WHEN doc_id % 23 = 0 THEN 'sha1:' ELSE 'sha256:' END || CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS id
      FROM documents) WHERE reason IS NOT NULL"""))
def _(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"), "text")
    declared = docs.select(
        F.col("doc_id").alias("payload_key"),
        F.expr("sha2(concat(text, if(doc_id % 13 = 0, 'x', '')), 256)").alias("sha256"),
        F.expr("octet_length(content) + if(doc_id % 19 = 0, 1, 0)").alias("byte_length"),
    ).withColumn("id", F.expr("concat(if(payload_key % 23 = 0, 'sha1:', 'sha256:'), sha256)"))
    payloads = docs.where("doc_id % 29 <> 0").select(F.col("doc_id").alias("payload_key"), "content")
    return G.artifact_errors(declared, payloads)


SLOT_IDS = [s for s, *_ in fixed.SLOTS]
SLOT_SQL = "[" + ", ".join(f"'{s}'" for s in [*SLOT_IDS, "unknown.a", "unknown.b"]) + "]"


def _recorded(spark, d) -> DataFrame:
    names = "array(" + ", ".join(f"'{s}'" for s in [*SLOT_IDS, "unknown.a", "unknown.b"]) + ")"
    return _lines(spark, d).selectExpr(
        "l_orderkey as project_id", f"element_at({names}, cast((l_linenumber * 5 + l_partkey) % 18 + 1 as int)) as slot_id",
        "if(l_quantity > 30, 'LOW_CONFIDENCE', 'PRESENT') as status")


I.CTES["recorded"] = f"""
SELECT l_orderkey AS project_id, {SLOT_SQL}[(l_linenumber * 5 + l_partkey) % 18 + 1] AS slot_id,
  min(CASE WHEN l_quantity > 30 THEN 'LOW_CONFIDENCE' ELSE 'PRESENT' END) AS status FROM lineitem GROUP BY 1, 2"""


@query("ontology_gaps", "project_id:l missing:l low_confidence:l unknown:l first_finding:s", sql(f"""
SELECT project_id, count(*) FILTER (WHERE finding = 'ontology-missing') AS missing,
  count(*) FILTER (WHERE finding = 'ontology-low-confidence') AS low_confidence,
  count(*) FILTER (WHERE finding = 'ontology-unknown') AS unknown, min(finding || '.' || slot_id) AS first_finding
FROM (SELECT coalesce(e.project_id, r.project_id) AS project_id, coalesce(e.slot_id, r.slot_id) AS slot_id,
        CASE WHEN e.slot_id IS NULL THEN 'ontology-unknown' WHEN status IS NULL THEN 'ontology-missing'
             WHEN status = 'LOW_CONFIDENCE' THEN 'ontology-low-confidence' END AS finding
      FROM (SELECT o_orderkey AS project_id, unnest({SLOT_SQL}[1:16]) AS slot_id FROM orders) e
      FULL JOIN recorded r ON e.project_id = r.project_id AND e.slot_id = r.slot_id)
WHERE finding IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    found = G.ontology_findings(_projects(spark, d), _recorded(spark, d), SLOT_IDS)
    count = lambda f: F.count_if(F.col("finding") == f)
    return found.groupBy("project_id").agg(
        count("ontology-missing").alias("missing"), count("ontology-low-confidence").alias("low_confidence"),
        count("ontology-unknown").alias("unknown"), F.min(F.concat("finding", F.lit("."), "slot_id")).alias("first_finding"))


PARAM_IDS = [p for p, *_ in fixed.PARAMETERS]
PARAM_VALUES = ", ".join(f"({i}, '{p}', '{c}', {lo}::DOUBLE, {hi}::DOUBLE, {n}::DOUBLE)" for i, (p, c, lo, hi, n, _) in enumerate(fixed.PARAMETERS))
I.CTES["preg"] = f"SELECT * FROM (VALUES {PARAM_VALUES}) AS t(idx, parameter_id, capability, low, high, neutral)"
I.CTES["params"] = """
SELECT p_partkey AS project_id, parameter_id, capability, low, high, neutral,
  low - CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS minimum, high AS maximum,
  neutral + CASE WHEN p_partkey % 7 = 0 THEN 0.25 ELSE 0 END AS default_value,
  least(neutral, low + (high - low) * 0.1) AS safe_minimum,
  greatest(neutral, high - (high - low) * 0.1) - CASE WHEN p_partkey % 11 = 0 THEN 50 ELSE 0 END AS safe_maximum,
  p_partkey % 5 <> 0 AS manual_enabled
FROM part JOIN preg ON idx = p_size % 10"""


def _parameters(spark, d) -> DataFrame:
    """One parameter per part, chosen by size, with some ranges, defaults and roles broken by the key."""
    registry = R.parameters(spark)
    return I.table(spark, d, "part").select("p_partkey", "p_size").join(
        F.broadcast(registry), F.expr("p_size % 10 = parameter_index")).selectExpr(
        "p_partkey as project_id", "parameter_id", "capability", "low - if(p_partkey % 13 = 0, 1, 0) as minimum", "high as maximum",
        "neutral + if(p_partkey % 7 = 0, 0.25D, 0) as default_value", "least(neutral, low + (high - low) * 0.1D) as safe_minimum",
        "greatest(neutral, high - (high - low) * 0.1D) - if(p_partkey % 11 = 0, 50, 0) as safe_maximum", "p_partkey % 5 <> 0 as manual_enabled")


def _bound(spark, d) -> DataFrame:
    return _lines(spark, d).where("l_quantity > 40").select(F.col("l_partkey").alias("project_id")).join(
        _parameters(spark, d).select("project_id", "parameter_id"), "project_id")


@query("parameter_rules", "project_id:l parameter_id:s finding:s", sql("""
SELECT project_id, parameter_id, unnest(list_filter([
  CASE WHEN NOT (minimum <= safe_minimum AND safe_minimum <= default_value AND default_value <= safe_maximum AND safe_maximum <= maximum) THEN 'parameter-range' END,
  CASE WHEN minimum < low OR maximum > high THEN 'parameter-registry-range' END,
  CASE WHEN neutral <> default_value THEN 'parameter-neutral' END,
  CASE WHEN capability = 'candidate_mandatory' AND NOT manual_enabled THEN 'parameter-manual' END,
  CASE WHEN capability = 'candidate_mandatory' AND project_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) THEN 'parameter-unbound' END
], lambda q: q IS NOT NULL)) AS finding FROM params"""))
def _(spark, d):
    return G.parameter_findings(_parameters(spark, d), R.parameters(spark), _bound(spark, d))


@query("layers_without_mesh", "project_id:l id:s", sql("""
SELECT l_orderkey AS project_id, 'e.' || l_linenumber AS id FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_partkey % 3 <> 0)"""))
def _(spark, d):
    lines = _lines(spark, d)
    layers = lines.selectExpr("l_orderkey as project_id", "concat('e.', l_linenumber) as id")
    meshes = lines.where("l_partkey % 3 <> 0").selectExpr("l_orderkey as project_id", "concat('e.', l_linenumber) as layer_id")
    return G.layers_without_mesh(layers, meshes)


@query("reason_codes_resolve", "code:s problem:s uses:l", sql("""
SELECT upper(event_type) AS code, 'unknown' AS problem, count(*) AS uses FROM events
WHERE event_type NOT IN (SELECT 'view' UNION SELECT lower(role) FROM conversations UNION SELECT 'click') GROUP BY 1 UNION ALL
SELECT code, 'both-axes', count(*) FROM (SELECT DISTINCT upper(role) AS code FROM conversations UNION ALL
  SELECT unnest(['VIEW', 'CLICK', 'USER'])) GROUP BY 1 HAVING count(*) > 1"""))
def _(spark, d):
    used = I.table(spark, d, "events").select(F.upper("event_type").alias("code"))
    causes = I.table(spark, d, "conversations").select(F.upper("role").alias("id")).distinct()
    findings = spark.createDataFrame([("VIEW",), ("CLICK",), ("USER",)], "id string")
    registry = causes.unionByName(findings)
    unknown = G.unknown_reason_codes(used, registry).select("code", F.lit("unknown").alias("problem"), "uses")
    twice = G.codes_on_both_axes(registry).select(F.col("id").alias("code"), F.lit("both-axes").alias("problem"), F.col("n").alias("uses"))
    return unknown.unionByName(twice)


# One reason-code registry for every brand of parts, with its parts as entries; one brand has causes only.
I.CTES["reason_entries"] = """
SELECT p_brand AS registry, '1.0.0' AS version, CASE WHEN p_partkey % 4 = 0 OR p_brand = 'Brand#11' THEN 'operational_causes' ELSE 'quality_findings' END AS axis, p_partkey AS position,
  CASE WHEN p_partkey % 61 <> 0 THEN 'CODE_' || (p_partkey % 997) END AS id, CASE WHEN p_partkey % 53 <> 0 THEN ['info', 'review', 'blocking', 'fatal'][CASE WHEN p_partkey % 97 = 0 THEN 4 ELSE p_size % 3 + 1 END] END AS severity FROM part"""


def _reason_entries(spark, d) -> DataFrame:
    return I.table(spark, d, "part").selectExpr(
        "p_brand as registry", "'1.0.0' as version", "if(p_partkey % 4 = 0 or p_brand = 'Brand#11', 'operational_causes', 'quality_findings') as axis", "cast(p_partkey as int) as position",
        "if(p_partkey % 61 <> 0, concat('CODE_', p_partkey % 997), null) as id",
        "if(p_partkey % 53 <> 0, element_at(array('info', 'review', 'blocking', 'fatal'), if(p_partkey % 97 = 0, 4, p_size % 3 + 1)), null) as severity")


@query("reason_registry_errors", "registry:s axis:s position:l id:s reason:s", sql("""
SELECT * FROM (WITH judged AS (SELECT registry, axis, position, id, CASE WHEN id IS NULL THEN 'ENTRY_MALFORMED' WHEN count(*) OVER (PARTITION BY registry, id) > 1 THEN 'ID_DUPLICATED'
  WHEN axis = 'quality_findings' AND (severity IS NULL OR severity NOT IN ('info', 'review', 'blocking')) THEN 'SEVERITY_UNSUPPORTED' END AS reason FROM reason_entries)
SELECT * FROM judged WHERE reason IS NOT NULL UNION ALL
SELECT registry, axis, NULL, NULL, 'AXIS_MISSING' FROM (SELECT DISTINCT registry FROM reason_entries), (SELECT unnest(['operational_causes', 'quality_findings']) AS axis)
WHERE (registry, axis) NOT IN (SELECT (registry, axis) FROM reason_entries))"""))
def _(spark, d):
    return R.reason_code_errors(_reason_entries(spark, d))


@query("finding_codes_resolve", "code:s problem:s uses:l", sql("""
SELECT code, CASE WHEN a IS NULL THEN 'UNKNOWN' ELSE 'WRONG_AXIS' END AS problem, uses FROM (SELECT 'CODE_' || (l_partkey % 1201) AS code, count(*) AS uses FROM lineitem GROUP BY 1)
LEFT JOIN (SELECT id AS code, list(DISTINCT axis) AS a FROM reason_entries WHERE id IS NOT NULL GROUP BY 1) USING (code) WHERE a IS NULL OR NOT list_contains(a, 'quality_findings')"""))
def _(spark, d):
    used = I.table(spark, d, "lineitem").selectExpr("concat('CODE_', l_partkey % 1201) as code")
    return G.unresolved_codes(used, _reason_entries(spark, d).where("id is not null"), "quality_findings")


def _findings(spark, d) -> DataFrame:
    severity = F.expr("case when l_returnflag = 'R' and l_discount > 0.08 then 'blocking' when l_returnflag = 'A' and l_tax > 0.05 then 'review' else 'info' end")
    return _lines(spark, d).where("l_linenumber > 2").select(F.col("l_orderkey").alias("project_id"), severity.alias("severity"))


I.CTES["findings"] = """
SELECT l_orderkey AS project_id, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 'blocking'
  WHEN l_returnflag = 'A' AND l_tax > 0.05 THEN 'review' ELSE 'info' END AS severity FROM lineitem WHERE l_linenumber > 2"""


@query("report_status", "project_id:l blocking:l review:l status:s", sql("""
SELECT o_orderkey AS project_id, count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'review') AS review,
  CASE WHEN blocking > 0 THEN 'blocked' WHEN review > 0 THEN 'pass_with_review' ELSE 'pass' END AS status
FROM orders LEFT JOIN findings ON o_orderkey = project_id GROUP BY 1"""))
def _(spark, d):
    return G.report_status(_projects(spark, d), _findings(spark, d))


@query("geometry_candidates", "project_id:l", sql("""
SELECT o_orderkey AS project_id FROM orders WHERE o_orderkey NOT IN (SELECT project_id FROM findings WHERE severity = 'blocking')"""))
def _(spark, d):
    return G.geometry_candidates(_projects(spark, d), _findings(spark, d))


@query("digest_binding", "package_id:l kind:s reason:s", sql("""
WITH records AS (
  SELECT l_orderkey AS package_id, ['report', 'run_manifest', 'release'][l_linenumber % 3 + 1] AS kind,
    sha256((l_orderkey + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS payload,
    l_orderkey * 10 + CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END AS revision FROM lineitem),
packages AS (SELECT o_orderkey AS package_id, sha256(o_orderkey::VARCHAR) AS expected, o_orderkey * 10 AS rev FROM orders WHERE o_orderkey % 21 <> 0)
SELECT package_id, kind, reason FROM (SELECT package_id, kind, CASE WHEN expected IS NULL THEN 'NO_PACKAGE'
    WHEN payload <> expected THEN 'PAYLOAD_DIGEST_MISMATCH' WHEN kind = 'run_manifest' AND revision <> rev THEN 'REVISION_MISMATCH' END AS reason
  FROM records LEFT JOIN packages USING (package_id)) WHERE reason IS NOT NULL"""))
def _(spark, d):
    packages = I.table(spark, d, "orders").where("o_orderkey % 21 <> 0").selectExpr("o_orderkey as package_id", "o_orderkey as payload", "o_orderkey * 10 as revision_id")
    records = _lines(spark, d).selectExpr(
        "l_orderkey as package_id", "element_at(array('report', 'run_manifest', 'release'), l_linenumber % 3 + 1) as kind",
        "l_orderkey + if(l_partkey % 9 = 0, 1, 0) as payload", "l_orderkey * 10 + if(l_partkey % 8 = 0, 1, 0) as revision_id")
    return G.digest_bindings(packages, records, lambda c: F.sha2(c.cast("string"), 256))


def _paths(spark, d) -> DataFrame:
    """Member paths: page locations and document artifacts with some unsafe shapes."""
    pages = I.table(spark, d, "pages").selectExpr("page_id as member_id", "regexp_replace(url, '^https?://', '') as path")
    docs = I.table(spark, d, "documents").selectExpr(
        "1000000000 + doc_id as member_id",
        r"case doc_id % 11 when 0 then concat('../', doc_id) when 1 then concat('a\\', doc_id) when 2 then concat('C:/', doc_id)"
        r" when 3 then concat('/', doc_id) when 4 then concat('a/b/c/d/', doc_id) when 5 then concat(' ', doc_id)"
        r" when 6 then substring(text, 1, 40) when 7 then repeat('n', 300) else concat('artifacts/', sha2(text, 256), '.bin') end as path")
    return pages.unionByName(docs)


@query("member_paths", "member_id:l reason:s", sql(r"""
SELECT member_id, reason FROM (SELECT member_id, CASE WHEN path = '' OR regexp_matches(path, '^\s|\s$') THEN 'EMPTY_OR_PADDED'
   WHEN strlen(path) > 255 THEN 'TOO_LONG' WHEN starts_with(path, '/') OR ends_with(path, '/') THEN 'NOT_RELATIVE'
   WHEN contains(path, '\') THEN 'BACKSLASH' WHEN substr(path, 2, 1) = ':' THEN 'DRIVE_LETTER'
   WHEN len(string_split(path, '/')) > 4 THEN 'TOO_DEEP'
   WHEN len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0 THEN 'TRAVERSAL'
   WHEN len(list_filter(string_split(path, '/'), lambda s: NOT regexp_matches(s, '^[\p{L}\p{N}._-]+$'))) > 0 THEN 'BAD_CHARACTER' END AS reason
 FROM (SELECT page_id AS member_id, regexp_replace(url, '^https?://', '') AS path FROM pages UNION ALL
  SELECT 1000000000 + doc_id, CASE doc_id % 11 WHEN 0 THEN '../' || doc_id WHEN 1 THEN 'a\' || doc_id WHEN 2 THEN 'C:/' || doc_id
   WHEN 3 THEN '/' || doc_id WHEN 4 THEN 'a/b/c/d/' || doc_id WHEN 5 THEN ' ' || doc_id WHEN 6 THEN substr(text, 1, 40)
   WHEN 7 THEN repeat('n', 300) ELSE 'artifacts/' || sha256(text) || '.bin' END FROM documents)) WHERE reason IS NOT NULL"""))
def _(spark, d):
    return K.member_path_errors(_paths(spark, d))


@query("path_collisions", "package_id:s folded:s uses:l kind:s", sql("""
SELECT package_id, lower(path) AS folded, count(*) AS uses,
  CASE WHEN count(*) > count(DISTINCT path) AND count(DISTINCT path) > 1 THEN 'both' WHEN count(DISTINCT path) > 1 THEN 'case' ELSE 'exact' END AS kind
FROM (SELECT source AS package_id, 'artifacts/' || CASE WHEN doc_id % 3 = 0 THEN upper(substr(sha256(text), 1, 3)) ELSE substr(sha256(text), 1, 3) END AS path FROM documents)
GROUP BY 1, 2 HAVING count(*) > 1"""))
def _(spark, d):
    members = I.table(spark, d, "documents").selectExpr(
        "source as package_id", "concat('artifacts/', if(doc_id % 3 = 0, upper(substring(sha2(text, 256), 1, 3)), substring(sha2(text, 256), 1, 3))) as path")
    return K.path_collisions(members)


@query("package_budgets", "package_id:s members:l largest:l total:l ratio:d violations:s", sql("""
SELECT package_id, count(*) AS members, max(n) AS largest, sum(n) AS total, round(max(ratio), 6) AS ratio,
  concat_ws(',', CASE WHEN count(*) > 40 THEN 'MEMBER_COUNT' END, CASE WHEN max(n) > 20000 THEN 'MEMBER_BYTES' END,
    CASE WHEN sum(n) > 60000 THEN 'TOTAL_BYTES' END, CASE WHEN max(ratio) > 200 THEN 'COMPRESSION_RATIO' END) AS violations
FROM (SELECT package_id, n, CASE WHEN c > 0 THEN n / c ELSE 0 END AS ratio FROM (
  SELECT source || '.' || lang AS package_id, strlen(text) AS n, strlen(text) // (1 + doc_id % 300) AS c FROM documents)) GROUP BY 1"""))
def _(spark, d):
    members = I.table(spark, d, "documents").selectExpr(
        "concat(source, '.', lang) as package_id", "octet_length(text) as byte_length", "octet_length(text) div (1 + doc_id % 300) as compressed_length")
    return K.package_budgets(members, 40, 20000, 60000, 200).select(
        "package_id", "members", "largest", "total", F.round("ratio", 6).alias("ratio"), F.array_join("violations", ",").alias("violations"))


I.CTES["members"] = """
SELECT source AS package_id, 'artifacts/' || doc_id || '.bin' AS path, strlen(text) AS len, sha256(text) AS sha FROM documents UNION ALL
SELECT DISTINCT source, 'index.json', 10, 'x' FROM documents"""
I.CTES["idx"] = """
SELECT source AS package_id, 'artifacts/' || doc_id || CASE WHEN doc_id % 37 = 0 THEN '.gone' ELSE '.bin' END AS path,
  strlen(text) + CASE WHEN doc_id % 43 = 0 THEN 1 ELSE 0 END AS len, CASE WHEN doc_id % 41 = 0 THEN sha256('') ELSE sha256(text) END AS sha
FROM documents WHERE doc_id % 31 <> 0 UNION ALL
SELECT source, 'artifacts/' || doc_id || '.bin', strlen(text), sha256(text) FROM documents WHERE doc_id % 53 = 0"""


@query("index_vs_members", "package_id:s path:s reason:s", sql("""
SELECT package_id, path, reason FROM (SELECT package_id, path, CASE WHEN entries > 1 THEN 'LISTED_TWICE' WHEN m.sha IS NULL THEN 'NOT_IN_PACKAGE'
    WHEN i.sha IS NULL THEN 'NOT_IN_INDEX' WHEN i.len <> m.len THEN 'LENGTH_MISMATCH' WHEN i.sha <> m.sha THEN 'DIGEST_MISMATCH' END AS reason
  FROM (SELECT package_id, path, count(*) AS entries, min(len) AS len, min(sha) AS sha FROM idx GROUP BY 1, 2) i
  FULL JOIN (SELECT * FROM members WHERE path <> 'index.json') m USING (package_id, path)) WHERE reason IS NOT NULL"""))
def _(spark, d):
    docs = I.table(spark, d, "documents").selectExpr("source", "doc_id", "octet_length(text) as n", "sha2(text, 256) as sha")
    members = docs.selectExpr("source as package_id", "concat('artifacts/', doc_id, '.bin') as path", "n as byte_length", "sha as sha256")
    members = members.unionByName(docs.selectExpr("source as package_id", "'index.json' as path", "10 as byte_length", "'x' as sha256").distinct())
    index = docs.where("doc_id % 31 <> 0").selectExpr(
        "source as package_id", "concat('artifacts/', doc_id, if(doc_id % 37 = 0, '.gone', '.bin')) as path",
        "n + if(doc_id % 43 = 0, 1, 0) as byte_length", "if(doc_id % 41 = 0, sha2('', 256), sha) as sha256")
    again = docs.where("doc_id % 53 = 0").selectExpr("source as package_id", "concat('artifacts/', doc_id, '.bin') as path", "n as byte_length", "sha as sha256")
    return K.index_differences(index.unionByName(again), members, "index.json")


@query("misplaced_artifacts", "doc_id:l path:s", sql("""
SELECT doc_id, path FROM (SELECT doc_id, sha256(text) AS sha, 'artifacts/' || CASE WHEN doc_id % 15 = 0 THEN sha256(lang) ELSE sha256(text) END || '.bin' AS path
  FROM documents) WHERE path <> 'artifacts/' || sha || '.bin'"""))
def _(spark, d):
    members = I.table(spark, d, "documents").selectExpr(
        "doc_id", "sha2(text, 256) as sha256", "concat('artifacts/', if(doc_id % 15 = 0, sha2(lang, 256), sha2(text, 256)), '.bin') as path")
    return K.misplaced_artifacts(members)


@query("registry_ref_resolves", "package_id:l registry:s sha256:s", sql("""
SELECT l_orderkey AS package_id, CASE WHEN l_linenumber % 2 = 0 THEN 'parameters' ELSE 'reason-codes' END AS registry, sha256((l_suppkey % 20)::VARCHAR) AS sha256
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_partkey % 20 = l.l_suppkey % 20)"""))
def _(spark, d):
    lines = _lines(spark, d)
    refs = lines.selectExpr("l_orderkey as package_id", "if(l_linenumber % 2 = 0, 'parameters', 'reason-codes') as registry", "l_suppkey % 20 as content")
    snapshots = lines.selectExpr("l_orderkey as package_id", "l_partkey % 20 as content")
    return K.unresolved_registry_refs(refs, snapshots, lambda c: F.sha2(c.cast("string"), 256))


BUNDLE_SQL = "[" + ", ".join(f"'{n}'" for n in K.expected_bundle_names()) + "]"


@query("bundle_verify", "bundle_id:l extra:l duplicated:l bad_length:l bad_digest:l total_bytes:l missing:l verified:b", sql(f"""
SELECT c_custkey AS bundle_id, count(*) FILTER (WHERE k > 80) AS extra, 0 AS duplicated,
  count(*) FILTER (WHERE (c_custkey * 7 + k) % 401 = 0) AS bad_length, count(*) FILTER (WHERE (c_custkey * 11 + k) % 509 = 0) AS bad_digest,
  sum(100 + k) AS total_bytes, 80 - count(*) FILTER (WHERE k <= 80) AS missing,
  extra = 0 AND bad_length = 0 AND bad_digest = 0 AND missing = 0 AND total_bytes <= 20000 AS verified
FROM (SELECT c_custkey, unnest(range(1, 82)) AS k FROM customer)
WHERE (k > 80 AND c_custkey % 9 = 0) OR (k <= 80 AND (c_custkey * 13 + k) % 307 <> 0) GROUP BY 1"""))
def _(spark, d):
    names = F.array(*[F.lit(n) for n in [*K.expected_bundle_names(), "stray.bin"]])
    bundles = I.spread(I.table(spark, d, "customer").select(F.col("c_custkey").alias("bundle_id")), "bundle_id")
    entries = bundles.select("bundle_id", F.posexplode(names).alias("p", "name")).withColumn("k", F.col("p") + 1).where(
        "(k > 80 and bundle_id % 9 = 0) or (k <= 80 and (bundle_id * 13 + k) % 307 <> 0)").selectExpr(
        "bundle_id", "name", "100 + k as actual_length", "100 + k + if((bundle_id * 7 + k) % 401 = 0, 1, 0) as byte_length",
        "sha2(name, 256) as actual_sha256", "if((bundle_id * 11 + k) % 509 = 0, 'other', sha2(name, 256)) as sha256")
    return K.verify_bundles(bundles, entries, 20000)


@query("inventory_reconcile", "run_id:l uri:s reason:s", sql("""
WITH declared AS (SELECT l_orderkey AS run_id, 'out/' || repeat('d/', l_linenumber) || (l_partkey % 7) AS uri, min(l_suppkey + l_partkey % 3) AS n, count(*) AS c
   FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2),
found AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey % 7) l_orderkey AS run_id, 'out/' || repeat('d/', l_linenumber) || (l_partkey % 7) AS uri, l_suppkey AS n
   FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey % 7) AS l_suppkey, l_quantity FROM lineitem WHERE l_quantity < 46))
SELECT run_id, uri, reason FROM (SELECT run_id, uri, CASE WHEN f.n IS NULL THEN 'MISSING' WHEN d.n IS NULL THEN 'UNDECLARED' WHEN c > 1 THEN 'DECLARED_TWICE'
   WHEN d.n <> f.n THEN 'LENGTH_MISMATCH' WHEN len(string_split(uri, '/')) > 7 THEN 'TOO_DEEP' WHEN f.n > 95 THEN 'TOO_LARGE' END AS reason
 FROM declared d FULL JOIN found f USING (run_id, uri)) WHERE reason IS NOT NULL"""))
def _(spark, d):
    lines = _lines(spark, d).selectExpr(
        "l_orderkey as run_id", "concat('out/', repeat('d/', l_linenumber), l_partkey % 7) as uri", "l_suppkey", "l_partkey", "l_quantity")
    declared = lines.where("l_quantity > 5").selectExpr("run_id", "uri", "l_suppkey + l_partkey % 3 as byte_length")
    found = lines.where("l_quantity < 46").groupBy("run_id", "uri").agg(F.min("l_suppkey").alias("byte_length"))
    return K.reconcile_inventory(declared, found, 7, 95)


@query("manifest_order", "manifest_id:s entries:l out_of_order:l has_psd:b", sql("""
SELECT manifest_id, count(*) AS entries, count(*) FILTER (WHERE prev IS NOT NULL AND path <= prev) AS out_of_order, bool_or(ends_with(path, '.psd')) AS has_psd
FROM (SELECT *, lag(path) OVER (PARTITION BY manifest_id ORDER BY position) AS prev FROM (
  SELECT source AS manifest_id, doc_id AS position, CASE WHEN doc_id % 17 = 0 THEN 'a' ELSE 'f' || lpad(doc_id::VARCHAR, 9, '0') END ||
    CASE WHEN doc_id % 211 = 0 THEN '.psd' ELSE '.png' END AS path FROM documents)) GROUP BY 1"""))
def _(spark, d):
    rows = I.table(spark, d, "documents").selectExpr(
        "source as manifest_id", "doc_id as position",
        "concat(if(doc_id % 17 = 0, 'a', concat('f', lpad(cast(doc_id as string), 9, '0'))), if(doc_id % 211 = 0, '.psd', '.png')) as path")
    return K.manifest_order(rows, block=64)


ROLE_SQL = "[" + ", ".join(f"'{r}'" for r in fixed.ROLE_PRIORITY) + "]"
SENS_SQL = "[" + ", ".join(f"'{r}'" for r in fixed.SENSITIVITY_PRIORITY) + "]"


@query("content_dedupe", "id:s uri:s sha256:s byte_length:l media_type:s role:s sensitivity:s copies:l media_type_clash:b", sql(f"""
SELECT 'sha256:' || sha AS id, 'artifacts/' || sha || CASE min(media) WHEN 'image/png' THEN '.png' WHEN 'application/json' THEN '.json' ELSE '.bin' END AS uri,
  sha AS sha256, max(n) AS byte_length, min(media) AS media_type, {ROLE_SQL}[min(role_rank)] AS role, {SENS_SQL}[min(sens_rank)] AS sensitivity,
  count(*) AS copies, min(media) <> max(media) AS media_type_clash
FROM (SELECT sha256(text) AS sha, strlen(text) AS n, doc_id % 10 + 1 AS role_rank, doc_id % 3 + 1 AS sens_rank,
  CASE WHEN doc_id % 50 = 0 THEN 'application/json' WHEN lang = 'en' THEN 'image/png' ELSE 'application/octet-stream' END AS media FROM documents)
GROUP BY sha"""))
def _(spark, d):
    arr = lambda names: "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    rows = I.table(spark, d, "documents").selectExpr(
        "sha2(text, 256) as sha256", "octet_length(text) as byte_length",
        f"element_at({arr(fixed.ROLE_PRIORITY)}, cast(doc_id % 10 + 1 as int)) as role",
        f"element_at({arr(fixed.SENSITIVITY_PRIORITY)}, cast(doc_id % 3 + 1 as int)) as sensitivity",
        "case when doc_id % 50 = 0 then 'application/json' when lang = 'en' then 'image/png' else 'application/octet-stream' end as media_type")
    return K.dedupe_content(rows)


@query("provenance_shape", "row_id:l line:l reason:s", sql("""
SELECT row_id, line, reason FROM (SELECT l_orderkey AS row_id, l_linenumber AS line,
  CASE WHEN kind = 'deterministic' AND k > 0 THEN 'DETERMINISTIC_HAS_MODEL_FIELD' WHEN kind = 'model_backed' AND k < 5 THEN 'MODEL_FIELD_MISSING'
       WHEN kind = 'manual' THEN 'UNKNOWN_PRODUCER' END AS reason
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'deterministic' WHEN 'R' THEN 'model_backed' ELSE CASE WHEN l_partkey % 50 = 0 THEN 'manual' ELSE 'deterministic' END END AS kind,
    CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END + CASE WHEN l_suppkey % 25 <> 0 AND l_returnflag = 'R' OR l_partkey % 40 = 0 THEN 1 ELSE 0 END AS k FROM lineitem))
WHERE reason IS NOT NULL"""))
def _(spark, d):
    model = "if(l_returnflag = 'R', 'v', null)"
    rows = _lines(spark, d).selectExpr(
        "l_orderkey as row_id", "l_linenumber as line",
        "case l_returnflag when 'A' then 'deterministic' when 'R' then 'model_backed' else if(l_partkey % 50 = 0, 'manual', 'deterministic') end as producer_kind",
        f"{model} as model_id", f"{model} as model_weights_sha256", f"{model} as execution_provider", f"{model} as precision",
        "if((l_suppkey % 25 <> 0 and l_returnflag = 'R') or l_partkey % 40 = 0, 'TP-001', null) as model_license_record_id")
    return G.provenance_errors(rows)


@query("structure_match", "doc_id:l position:l name:s reason:s", sql("""
WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber AS position, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
m AS (SELECT doc_id, position, 'n' || position AS name, p % 50 AS l, s % 40 AS t, p % 50 + 10 AS r, s % 40 + 10 AS b FROM u WHERE p % 43 <> 0),
dep AS (SELECT doc_id, position, 'n' || position AS name, p % 50 AS l, s % 40 AS t, p % 50 + 10 + CASE WHEN p % 23 = 0 THEN 1 ELSE 0 END AS r, s % 40 + 10 AS b FROM u WHERE p % 19 <> 0),
meta AS (SELECT doc_id, CASE WHEN s % 41 = 0 THEN 'x' ELSE 'n' END || position AS name, CASE WHEN p % 29 = 0 THEN 'other' ELSE 'n' || position END AS tag, [p % 50, s % 40, p % 50 + 10, s % 40 + 10 + CASE WHEN s % 31 = 0 THEN 2 ELSE 0 END] AS box,
  q / 49 AS median, CASE WHEN p % 3 = 0 THEN p % 7 - 1 END AS part_id FROM u WHERE s % 37 <> 0)
SELECT doc_id, position, name, reason FROM (SELECT doc_id, position, name,
  CASE WHEN position IS NULL THEN 'LAYER_MISSING' WHEN ml IS NULL OR dl IS NULL OR mr <> dr THEN 'PANELS_DIFFER' WHEN box IS NULL THEN 'METADATA_MISSING' WHEN tag <> name THEN 'TAG_MISMATCH'
       WHEN box <> [ml, mt, mr, mb] THEN 'BOX_MISMATCH' WHEN median > 1 THEN 'DEPTH_MEDIAN_INVALID' WHEN part_id < 0 THEN 'PART_ID_INVALID' END AS reason
  FROM (SELECT doc_id, position, coalesce(m.name, dep.name) AS name, m.l AS ml, m.t AS mt, m.r AS mr, m.b AS mb, dep.l AS dl, dep.r AS dr FROM m FULL JOIN dep USING (doc_id, position))
  FULL JOIN meta USING (doc_id, name)) WHERE reason IS NOT NULL"""))
def _(spark, d):
    u = _lines(spark, d).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position")).agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    main = u.where("p % 43 <> 0").selectExpr("doc_id", "position", "concat('n', position) as name", "p % 50 as left", "s % 40 as top", "p % 50 + 10 as right", "s % 40 + 10 as bottom")
    depth = u.where("p % 19 <> 0").selectExpr("doc_id", "position", "concat('n', position) as name", "p % 50 as left", "s % 40 as top",
                                              "p % 50 + 10 + if(p % 23 = 0, 1, 0) as right", "s % 40 + 10 as bottom")
    meta = u.where("s % 37 <> 0").selectExpr("doc_id", "concat(if(s % 41 = 0, 'x', 'n'), position) as name", "if(p % 29 = 0, 'other', concat('n', position)) as tag",
                                             "array(p % 50, s % 40, p % 50 + 10, s % 40 + 10 + if(s % 31 = 0, 2, 0)) as box", "q / 49 as depth_median", "if(p % 3 = 0, p % 7 - 1, null) as part_id")
    return G.structure_mismatches(main, depth, meta)


@query("stats_sane", "run_id:l line:l reason:s", sql("""
SELECT run_id, line, reason FROM (SELECT l_orderkey AS run_id, l_linenumber AS line,
  CASE WHEN l_discount - 0.01 < 0 THEN 'NOT_A_MEASUREMENT' WHEN 0.12 < (l_discount - 0.01) + l_tax THEN 'TOTAL_BELOW_PARTS' END AS reason FROM lineitem) WHERE reason IS NOT NULL"""))
def _(spark, d):
    stats = _lines(spark, d).selectExpr("l_orderkey as run_id", "l_linenumber as line", "l_discount - 0.01D as layer_time", "l_tax as depth_time", "0.12D as total_time")
    return G.stats_errors(stats, ["layer_time", "depth_time"], "total_time")


@query("registry_drift", "entry_id:l path:s old_value:s new_value:s change:s", sql("""
WITH o AS (SELECT p_partkey AS entry_id, unnest(['identity.name', 'identity.brand', 'kind', 'size']) AS path, unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS v FROM part WHERE p_partkey % 97 <> 0),
n AS (SELECT p_partkey AS entry_id, unnest(['identity.name', 'identity.brand', 'kind', 'size']) AS path,
  unnest([CASE WHEN p_partkey % 20 = 0 THEN upper(p_name) ELSE p_name END, CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE p_brand END, p_type, (p_size + CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END)::VARCHAR]) AS v FROM part WHERE p_partkey % 89 <> 0)
SELECT entry_id, path, old_value, new_value, change FROM (SELECT coalesce(o.entry_id, n.entry_id) AS entry_id, coalesce(o.path, n.path) AS path, o.v AS old_value, n.v AS new_value,
  CASE WHEN o.entry_id IS NULL THEN 'added' WHEN n.entry_id IS NULL THEN 'removed' WHEN o.v IS DISTINCT FROM n.v THEN 'changed' END AS change
  FROM o FULL JOIN n ON o.entry_id = n.entry_id AND o.path = n.path) WHERE change IS NOT NULL"""))
def _(spark, d):
    part = I.table(spark, d, "part")
    shape = lambda name, brand, size: [F.col("p_partkey").alias("entry_id"), F.struct(F.expr(name).alias("name"), F.expr(brand).alias("brand")).alias("identity"),
                                       F.col("p_type").alias("kind"), F.expr(size).alias("size")]
    old = part.where("p_partkey % 97 <> 0").select(*shape("p_name", "p_brand", "p_size"))
    new = part.where("p_partkey % 89 <> 0").select(*shape(
        "if(p_partkey % 20 = 0, upper(p_name), p_name)", "if(p_partkey % 33 = 0, null, p_brand)", "p_size + if(p_partkey % 41 = 0, 1, 0)"))
    return G.registry_drift(G.leaves(old, ["entry_id"]), G.leaves(new, ["entry_id"]), ["entry_id"])


@query("legacy_project_checks", "project_id:l edge:s owner_id:s target_id:s", sql("""
WITH e AS (
 SELECT l_orderkey AS project_id, 'layer-artifact' AS edge, 'l.' || l_linenumber AS owner_id, CASE WHEN l_partkey % 4 <> 0 THEN 'a.' || l_partkey % 9 END AS target_id FROM lineitem UNION ALL
 SELECT l_orderkey, 'deformer-parent', 'd.' || l_linenumber, CASE WHEN l_linenumber > 1 THEN 'd.' || (l_linenumber - 1) END FROM lineitem UNION ALL
 SELECT l_orderkey, 'deformer-target', 'd.' || l_linenumber, unnest(['m.' || l_linenumber, 'd.' || (l_linenumber + l_partkey % 2)]) FROM lineitem UNION ALL
 SELECT l_orderkey, 'binding-artifact', 'b.' || l_linenumber, 'a.' || l_suppkey % 9 FROM lineitem UNION ALL
 SELECT l_orderkey, 'binding-parameter', 'b.' || l_linenumber, unnest(['p.' || l_suppkey % 6, 'p.' || (l_suppkey % 6 + 10)]) FROM lineitem),
t AS (
 SELECT l_orderkey AS project_id, unnest(['layer-artifact', 'binding-artifact']) AS edge, 'a.' || l_partkey % 9 AS id FROM lineitem WHERE l_partkey % 3 <> 0 UNION ALL
 SELECT l_orderkey, unnest(['deformer-parent', 'deformer-target']), 'd.' || l_linenumber FROM lineitem UNION ALL
 SELECT l_orderkey, 'deformer-target', 'm.' || l_linenumber FROM lineitem WHERE l_linenumber <= 4 UNION ALL
 SELECT l_orderkey, 'binding-parameter', unnest(['p.' || l_partkey % 6, 'p.' || (l_suppkey % 6 + 10)]) FROM lineitem)
SELECT * FROM e WHERE target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.project_id = e.project_id AND t.edge = e.edge AND t.id = e.target_id)"""))
def _(spark, d):
    lines = _lines(spark, d)
    pid = "l_orderkey as project_id"
    layers = lines.selectExpr(pid, "concat('l.', l_linenumber) as id", "if(l_partkey % 4 <> 0, concat('a.', l_partkey % 9), null) as texture_artifact_id")
    artifacts = lines.where("l_partkey % 3 <> 0").selectExpr(pid, "concat('a.', l_partkey % 9) as id")
    deformers = lines.selectExpr(pid, "concat('d.', l_linenumber) as id", "if(l_linenumber > 1, concat('d.', l_linenumber - 1), null) as parent_id",
                                 "array(concat('m.', l_linenumber), concat('d.', l_linenumber + l_partkey % 2)) as target_ids")
    meshes = lines.where("l_linenumber <= 4").selectExpr(pid, "concat('m.', l_linenumber) as id")
    bindings = lines.selectExpr(pid, "concat('b.', l_linenumber) as id", "concat('a.', l_suppkey % 9) as artifact_id",
                                "map(concat('p.', l_suppkey % 6), 1.0D, concat('p.', l_suppkey % 6 + 10), 0.0D) as parameter_samples")
    parameters = lines.selectExpr(pid, "explode(array(concat('p.', l_partkey % 6), concat('p.', l_suppkey % 6 + 10))) as id")
    return G.legacy_project_errors(layers, artifacts, deformers, meshes, bindings, parameters)


@query("link_check", "doc_id:l target:s reason:s", sql("""
WITH host AS (SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS site, split_part(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '^/', ''), '?', 1) AS path, html FROM pages),
links AS (SELECT page_id, site, regexp_replace(path, '/?[^/]*$', '') AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM host),
formed AS (SELECT page_id, site, base, unnest([raw, ltrim(raw, '/'), '../' || ltrim(raw, '/'), './../../../' || ltrim(raw, '/')]) AS raw FROM links),
t AS (SELECT DISTINCT site, path FROM host),
l AS (SELECT page_id, site, base, trim(split_part(raw, '#', 1)) AS target FROM formed),
r AS (SELECT page_id, site, target, list_reduce(list_filter(string_split(CASE WHEN starts_with(target, '/') THEN target ELSE base || '/' || target END, '/'), lambda s: s NOT IN ('', '.')),
  lambda p, s: CASE WHEN p = '!' THEN '!' WHEN s = '..' THEN CASE WHEN p = '' THEN '!' ELSE regexp_replace(p, '/?[^/]*$', '') END WHEN p = '' THEN s ELSE p || '/' || s END, '') AS path
  FROM l WHERE target <> '' AND NOT regexp_matches(target, '^(http://|https://|mailto:)'))
SELECT page_id AS doc_id, target, CASE WHEN path = '!' THEN 'ESCAPES_ROOT' ELSE 'BROKEN' END AS reason FROM r WHERE path = '!' OR NOT EXISTS (SELECT 1 FROM t WHERE t.site = r.site AND t.path = r.path)"""))
def _(spark, d):
    """Every link as it is, relative to its page, from the folder above it, and from too far above."""
    path = "split_part(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '^/', ''), '?', 1)"
    pages = I.table(spark, d, "pages").selectExpr(
        "page_id as doc_id", "split_part(regexp_replace(url, '^https?://', ''), '/', 1) as site", f"regexp_replace({path}, '/?[^/]*$', '') as base", "html", f"{path} as path")
    links = K.extract_links(pages, "html", 'href="([^"]*)"').selectExpr(
        "doc_id", "site", "base", "explode(array(target, ltrim('/', target), concat('../', ltrim('/', target)), concat('./../../../', ltrim('/', target)))) as target")
    return K.local_link_errors(links, pages.select("site", "path"))


@query("index_coverage", "site:s target:s", sql("""
WITH host AS (SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS site, html FROM pages),
links AS (SELECT site, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM host)
SELECT site, target FROM (SELECT DISTINCT site, unnest(['/the', '/and', '/to', '/of', '/The']) AS target FROM host) r
WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.site = r.site AND links.target = r.target)"""))
def _(spark, d):
    pages = I.table(spark, d, "pages").selectExpr("split_part(regexp_replace(url, '^https?://', ''), '/', 1) as site", "html")
    links = K.extract_links(pages, "html", 'href="([^"]*)"').select("site", "target")
    required = pages.select("site").distinct().selectExpr("site", "explode(array('/the', '/and', '/to', '/of', '/The')) as target")
    return K.missing_index_links(required, links)


@query("phrase_scan", "doc_id:l phrase:s", sql("""
SELECT doc_id, phrase FROM (SELECT doc_id, lower(text) AS t, unnest(['license', 'copyright', 'password', 'all rights', 'the and']) AS phrase FROM documents) WHERE contains(t, phrase)"""))
def _(spark, d):
    return K.phrase_hits(I.table(spark, d, "documents"), "text", ["license", "copyright", "password", "all rights", "the and"])


@query("missing_prefixes", "doc_id:l prefix:s", sql("""
SELECT doc_id, prefix FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|\\n)([A-Z])[a-z]+', 1) AS used, unnest(['A', 'E', 'T', 'L']) AS prefix FROM documents)
WHERE NOT list_contains(used, prefix)"""))
def _(spark, d):
    return K.missing_prefixes(I.table(spark, d, "documents"), "text", r"(?:^|\n)([A-Z])[a-z]+", ["A", "E", "T", "L"])
