"""Queries over uploads, nested documents, artifacts to write and reports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_folder
from ..sources import documents as V
from ..sources import files as S
from ..sources import registries as R
from ..sources import sinks as W
from . import inputs as I
from .inputs import sql
from .registry import query


@query("raster_pixels", "image_id:l x:l y:l r:l g:l b:l a:l", sql("SELECT image_id, x, y, r, g, b, CASE WHEN image_id % 2 = 0 THEN 255 ELSE a END AS a FROM px"))
def _(spark, d):
    # blobs in the image source's layout: even images without alpha
    hexed = lambda c: f"lpad(hex({c}), 2, '0')"
    cell = I.pixels(spark, d).select("image_id", "x", "y", F.expr(f"concat({hexed('b')}, {hexed('g')}, {hexed('r')}, if(image_id % 2 = 0, '', {hexed('a')}))").alias("h"))
    line = cell.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "h"))).alias("c")).select("image_id", "y", F.expr("array_join(transform(c, q -> q.h), '')").alias("h"))
    blob = line.groupBy("image_id").agg(F.count("*").alias("height"), F.array_sort(F.collect_list(F.struct("y", "h"))).alias("c"))
    rasters = blob.select("image_id", F.lit(64).alias("width"), F.col("height").cast("int").alias("height"), F.expr("if(image_id % 2 = 0, 3, 4)").alias("channels"),
                          F.expr("unhex(array_join(transform(c, q -> q.h), ''))").alias("data"))
    return S.raster_pixels(rasters)


@query("upload_verdicts", "upload_id:l sniffed_type:s reason_code:s sha256:s", sql(r"""
SELECT upload_id, sniffed AS sniffed_type, reason AS reason_code, CASE WHEN reason IS NULL THEN sha256(content) END AS sha256 FROM (
  SELECT *, CASE WHEN octet_length(content) = 0 THEN 'INPUT_UNSUPPORTED' WHEN declared NOT IN ('image/png', 'image/jpeg') THEN 'INPUT_UNSUPPORTED' WHEN sniffed IS NULL OR sniffed <> declared THEN 'INPUT_UNSUPPORTED' END AS reason FROM (
    SELECT *, CASE WHEN upload_id % 3 = 0 AND upload_id % 17 <> 0 THEN 'image/png' WHEN upload_id % 3 = 1 AND upload_id % 17 <> 0 THEN 'image/jpeg' END AS sniffed FROM (
      SELECT doc_id AS upload_id, CASE WHEN doc_id % 17 = 0 THEN ''::BLOB WHEN doc_id % 3 = 0 THEN unhex('89504E470D0A1A0A') || encode(text) WHEN doc_id % 3 = 1 THEN unhex('FFD8FF') || encode(text) ELSE encode(text) END AS content,
        CASE doc_id % 5 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/jpeg' ELSE 'image/png' END AS declared FROM documents)))"""))
def _(spark, d):
    uploads = I.table(spark, d, "documents").selectExpr(
        "doc_id as upload_id",
        "case when doc_id % 17 = 0 then unhex('') when doc_id % 3 = 0 then concat(unhex('89504E470D0A1A0A'), encode(text, 'utf-8')) when doc_id % 3 = 1 then concat(unhex('FFD8FF'), encode(text, 'utf-8')) else encode(text, 'utf-8') end as content",
        "case doc_id % 5 when 0 then 'image/gif' when 1 then 'image/jpeg' else 'image/png' end as declared_type")
    return S.upload_verdicts(uploads.withColumn("length", F.octet_length("content")))


@query("raster_facts", "image_id:l width:l height:l had_alpha:b reason_code:s", sql("""
SELECT image_id, any_value(width) AS width, any_value(height) AS height, bool_or(CASE WHEN image_id % 2 = 0 THEN 255 ELSE a END < 255) AS had_alpha,
  CASE WHEN any_value(width * height) > 4000 THEN 'STAGE_RESOURCE_LIMIT_EXCEEDED' WHEN any_value(height) < 55 THEN 'INPUT_UNSUPPORTED' END AS reason_code FROM px JOIN img USING (image_id) GROUP BY 1"""))
def _(spark, d):
    pixels = I.pixels(spark, d).withColumn("a", F.expr("if(image_id % 2 = 0, 255, a)"))
    return S.raster_facts(I.images(spark, d), pixels, min_side=55, max_side=64, max_pixels=4000)


# --- versioned documents --------------------------------------------------------------------------------------------
# One project document for every order. The fields of each part, for its element ``e``, are given once, in words that both
# dialects know; HASH stands for SHA-256 in hex. Of twenty orders, some have a document with one fault each.
FORMAT = "project"
NUMBER, TEXT, FLAG, LIST, BOX = "d", "s", "b", "list", "box"
PARTS: dict[str, list[tuple[str, str, str]]] = {
    "ontology_completion": [
        ("slot_id", TEXT, "'slot.' || (o_custkey % 16)"), ("status", TEXT, "CASE WHEN o_custkey % 3 = 0 THEN 'PRESENT' WHEN o_custkey % 3 = 1 THEN 'NOT_APPLICABLE' ELSE 'LOW_CONFIDENCE' END"),
        ("instance_ids", LIST, "'layer.' || e"), ("confidence_fact_ids", LIST, "'fact.' || e"), ("reason_codes", LIST, "'REASON_' || e"), ("evidence_artifact_ids", LIST, "'sha256:' || HASH('ev' || o_orderkey)")],
    "artifacts": [
        ("id", TEXT, "'sha256:' || HASH(o_orderkey || '.' || e)"), ("uri", TEXT, "'artifacts/' || e || '.bin'"), ("sha256", TEXT, "HASH(o_orderkey || '.' || e)"), ("byte_length", NUMBER, "o_custkey * 10 + e"),
        ("media_type", TEXT, "'image/png'"), ("role", TEXT, "CASE WHEN e = 0 THEN 'source' ELSE 'layer_texture' END"), ("sensitivity", TEXT, "'derived_user_content'")],
    "confidence_facts": [
        ("id", TEXT, "'fact.' || e"), ("target_id", TEXT, "'layer.' || e"), ("score", "score", "o_custkey % 100 / 100"), ("calibration_dataset_id", TEXT, "'data.' || (o_custkey % 7)"),
        ("calibration_method", TEXT, "'isotonic'"), ("calibration_version", TEXT, "'1.' || e"), ("threshold_band", TEXT, "CASE WHEN o_custkey % 3 = 0 THEN 'unavailable' ELSE 'auto' END"),
        ("evidence_artifact_ids", LIST, "'sha256:' || HASH('fact' || e)"), ("provenance_id", TEXT, "'prov.' || e")],
    "layers": [
        ("id", TEXT, "'layer.' || e"), ("display_name", TEXT, "'Layer ' || e || ' of ' || o_orderkey"), ("slot_id", TEXT, "'slot.' || (o_custkey % 16)"), ("side", TEXT, "CASE WHEN e = 0 THEN 'left' ELSE 'none' END"),
        ("texture_artifact_id", TEXT, "'sha256:' || HASH('tx' || e)"), ("bounds", BOX, "o_custkey % 50 + e"), ("visible", FLAG, "o_custkey % 2 = 0"), ("opacity", NUMBER, "o_custkey % 101 / 100"),
        ("blend_mode", TEXT, "'normal'"), ("draw_order", NUMBER, "e + o_custkey % 5")],
    "generated_regions": [
        ("id", TEXT, "'region.' || e"), ("owner_layer_id", TEXT, "'layer.' || e"), ("mask_artifact_id", TEXT, "'sha256:' || HASH('mask' || e)"), ("reveal_bounds", BOX, "o_orderkey % 60 + e"),
        ("feather_width_px", NUMBER, "o_custkey % 9 / 2"), ("confidence_fact_id", TEXT, "'fact.' || e"), ("provenance_id", TEXT, "'prov.' || e")],
    "meshes": [
        ("id", TEXT, "'mesh.' || e"), ("layer_id", TEXT, "'layer.' || e"), ("vertex_payload_artifact_id", TEXT, "'sha256:' || HASH('v' || e)"), ("vertex_payload_format", TEXT, "'mesh.xyuv.f32le.v1'"),
        ("index_payload_artifact_id", TEXT, "'sha256:' || HASH('i' || e)"), ("index_payload_format", TEXT, "CASE WHEN o_custkey % 2 = 0 THEN 'indices.u16le.v1' ELSE 'indices.u32le.v1' END"),
        ("vertex_count", NUMBER, "o_custkey % 1000 + 3"), ("triangle_count", NUMBER, "o_custkey % 900 + 1"), ("winding", TEXT, "'clockwise'")],
    "parameters": [
        ("id", TEXT, "'param.' || e"), ("capability", TEXT, "CASE WHEN e = 0 THEN 'mandatory' ELSE 'optional' END"), ("minimum", NUMBER, "0 - o_custkey % 30"), ("default", NUMBER, "e / 4"), ("maximum", NUMBER, "o_custkey % 30 + 1"),
        ("safe_minimum", NUMBER, "0 - o_custkey % 20"), ("safe_maximum", NUMBER, "o_custkey % 20 + 1"), ("clamp", FLAG, "true"), ("manual_enabled", FLAG, "true"), ("tracking_enabled", FLAG, "o_custkey % 2 = 1")],
    "bindings": [
        ("id", TEXT, "'bind.' || e"), ("parameter_id", TEXT, "'param.' || e"), ("target_mesh_id", TEXT, "'mesh.' || e"), ("samples", "samples", "o_custkey % 7"), ("interpolation", TEXT, "'linear'"), ("extrapolation", TEXT, "'clamp'")],
    "provenance": [
        ("id", TEXT, "'prov.' || e"), ("producer_kind", TEXT, "CASE WHEN e = 0 THEN 'deterministic' ELSE 'model_backed' END"), ("stage_id", TEXT, "'stage.' || (o_custkey % 5)"), ("implementation_version", TEXT, "'2.' || e"),
        ("config_sha256", TEXT, "HASH('c' || o_custkey)"), ("seed_u64", TEXT, "'0000000000000000000' || (o_custkey % 10)"), ("input_sha256", LIST, "HASH('in' || e)"),
        ("model_id", TEXT, "CASE WHEN e > 0 THEN 'model.' || e END"), ("model_weights_sha256", TEXT, "CASE WHEN e > 0 THEN HASH('w' || e) END"), ("model_license_record_id", TEXT, "CASE WHEN e > 0 THEN 'TP-00' || e END"),
        ("execution_provider", TEXT, "CASE WHEN e > 0 THEN 'cpu' END"), ("precision", TEXT, "CASE WHEN e > 0 THEN 'fp32' END")],
    "user_overrides": [
        ("id", TEXT, "'over.' || e"), ("target_id", TEXT, "'layer.' || e"), ("operation", TEXT, "CASE WHEN e = 0 THEN 'mask_add' WHEN e = 1 THEN 'draw_order_override' ELSE 'range_reduce' END"),
        ("parent_revision_id", TEXT, "'rev.' || (o_custkey % 9)"), ("created_at", TEXT, "'2026-01-0' || (1 + e) || 'T00:00:00Z'"), ("replay_attempt_id", TEXT, "'replay.' || e"),
        ("replay_status", TEXT, "CASE WHEN o_custkey % 2 = 0 THEN 'clean' ELSE 'conflict' END"), ("reason_code", TEXT, "CASE WHEN o_custkey % 2 = 1 THEN 'REPLAY_CONFLICT' END"),
        ("mask_artifact_id", TEXT, "CASE WHEN e = 0 THEN 'sha256:' || HASH('o' || o_custkey) END"), ("mask_format", TEXT, "CASE WHEN e = 0 THEN 'mask.u8.v1' END"), ("new_draw_order", NUMBER, "CASE WHEN e = 1 THEN o_custkey % 12 END"),
        ("safe_minimum", NUMBER, "CASE WHEN e = 2 THEN 0 - o_custkey % 8 END"), ("safe_maximum", NUMBER, "CASE WHEN e = 2 THEN o_custkey % 8 END"), ("replacement_artifact_id", TEXT, "CASE WHEN e = 9 THEN 'none' END")],
}
#: Remainder of the order by 20: the fault of its document, as an expression over the sound text, and the reason it gets.
FAULTS = {
    0: ("replace(body, '\"0.2.0\"', '\"0.3.0\"')", "VERSION_UNKNOWN"), 1: ("substring(body, 1, 60)", "DOCUMENT_UNREADABLE"),
    2: ("replace(body, '\"0.2.0\"', '\"0.1.0\"')", "PART_MALFORMED:occlusion_edges"), 3: (f"replace(body, '\"{FORMAT}\"', '\"other\"')", "FORMAT_UNKNOWN"),
    5: ("replace(body, '\"draw_order\":', '\"draw_order\":\"high\",\"was\":')", "PART_MALFORMED:layers"), 6: ("replace(body, '\"meshes\":[{\"id\"', '\"meshes\":[{\"nid\"')", "PART_MALFORMED:meshes"),
    7: ("replace(body, '\"bindings\":', '\"bound\":')", "PART_MALFORMED:bindings"), 9: ("replace(body, '\"project_id\":', '\"pid\":')", "HEAD_MALFORMED"),
}


def _project_documents(spark, d, *keep: str) -> DataFrame:
    """The ingested documents; ``keep`` names what of them will be read."""
    texts = _project_texts(spark, d)
    return V.ingest_projects(texts, "value", FORMAT, keep) if keep else V.ingest_projects(texts, "value", FORMAT)


def _project_texts(spark, d) -> DataFrame:
    def value(kind: str, expr: str) -> str:
        expr = re.sub(r"HASH\(([^()]*)\)", r"sha2(\1, 256)", expr)
        return {
            LIST: f"array({expr}, concat({expr}, '.b'))", BOX: f"named_struct('x', {expr}, 'y', {expr} + 1.5D, 'width', 20, 'height', 30.25D, 'unit', 'pixel', 'space', 'source')",
            "score": f"if(o_custkey % 3 = 0, 'unavailable', cast({expr} as string))",
            "samples": f"transform(array(-1, 0, 1), v -> named_struct('parameter_value', v * ({expr}), 'delta_artifact_id', concat('delta.', v), 'delta_format', 'delta.xy.f32le.v1'))"}.get(kind, expr)

    element = {part: "named_struct(" + ", ".join(f"'{name}', {value(kind, expr)}" for name, kind, expr in fields) + ")" for part, fields in PARTS.items()}
    arrays = ", ".join(f"'{part}', transform(slice(array(0, 1, 2), 1, cast(o_orderkey % 4 as int)), e -> {text})" for part, text in element.items())
    registry = lambda n: f"named_struct('id', '{n}', 'version', '1.0.0', 'sha256', sha2('{n}', 256))"
    body = F.expr(f"""to_json(named_struct('format', '{FORMAT}', 'format_version', '0.2.0', 'project_id', concat('project.', o_orderkey), 'revision_id', concat('rev.', o_custkey % 9), 'created_at', '2026-01-01T00:00:00Z',
      'canvas', named_struct('width', 1024 + o_custkey % 10, 'height', 1024, 'image_origin', 'top-left', 'color_space', 'srgb', 'alpha_mode', 'straight'), 'ontology_registry_version', '0.1.0',
      'reason_code_registry', {registry('reasons')}, 'parameter_registry', {registry('parameters')}, {arrays}, 'extensions', map()))""")
    fault = "case o_orderkey % 20 " + " ".join(f"when {k} then {text}" for k, (text, _) in FAULTS.items()) + " else body end"
    return I.spread(I.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("body", body).select("o_orderkey", F.expr(fault).alias("value"))


SOUND = f"o_orderkey % 20 NOT IN ({', '.join(map(str, FAULTS))})"


def _part_query(part: str) -> None:
    shown, columns = [], ["project_id:s", "revision_id:s", "position:l"]
    picked = []
    for name, kind, expr in PARTS[part]:
        expr = re.sub(r"HASH\(", "sha256(", expr)
        if kind == LIST:
            shown.append(f"{expr} || ',' || {expr} || '.b' AS {name}")
            picked.append(f"array_join({name}, ',') as {name}")
            columns.append(f"{name}:s")
        elif kind == BOX:
            shown += [f"{expr} AS {name}_x", f"{expr} + 1.5 AS {name}_y", f"20 AS {name}_width", f"30.25 AS {name}_height", f"'pixel source' AS {name}_in"]
            picked += [*[f"{name}.{f} as {name}_{f}" for f in ("x", "y", "width", "height")], f"concat_ws(' ', {name}.unit, {name}.space) as {name}_in"]
            columns += [*[f"{name}_{f}:d" for f in ("x", "y", "width", "height")], f"{name}_in:s"]
        elif kind == "score":
            shown += [f"CASE WHEN o_custkey % 3 <> 0 THEN {expr} END AS score", "o_custkey % 3 <> 0 AS score_available"]
            picked += ["score", "score_available"]
            columns += ["score:d", "score_available:b"]
        elif kind == "samples":
            shown.append(f"(-1 * ({expr})) || ':delta.-1,0:delta.0,' || ({expr}) || ':delta.1' AS samples")
            picked.append("array_join(transform(samples, s -> concat(cast(s.parameter_value as bigint), ':', s.delta_artifact_id)), ',') as samples")
            columns.append("samples:s")
        else:
            alias = f"{name}_value" if name == "default" else name
            shown.append(f"{expr} AS {alias}")
            picked.append(f"`{name}` as {alias}")
            columns.append(f"{alias}:{kind}")
    text = f"SELECT 'project.' || o_orderkey AS project_id, 'rev.' || (o_custkey % 9) AS revision_id, e AS position, {', '.join(shown)} FROM (SELECT *, unnest(range(0, o_orderkey % 4)) AS e FROM orders WHERE {SOUND})"

    @query(f"project_{part}", " ".join(columns), text)
    def _(spark, d):
        return V.part(_project_documents(spark, d, part), part, "0.2.0").selectExpr("project_id", "revision_id", "position", *picked)


for _name in PARTS:
    _part_query(_name)


@query("project_heads", "project_id:s revision_id:s created_at:s width:l image_origin:s parameter_registry:s", f"""
SELECT 'project.' || o_orderkey AS project_id, 'rev.' || (o_custkey % 9) AS revision_id, '2026-01-01T00:00:00Z' AS created_at, 1024 + o_custkey % 10 AS width, 'top-left' AS image_origin,
  'parameters@1.0.0' AS parameter_registry FROM orders WHERE {SOUND}""")
def _(spark, d):
    return V.heads(_project_documents(spark, d, "head"), "0.2.0").select(
        "project_id", "revision_id", "created_at", "canvas.width", "canvas.image_origin", F.concat_ws("@", "parameter_registry.id", "parameter_registry.version").alias("parameter_registry"))


@query("rejected_documents", "order_id:l format_version:s reason_code:s", "SELECT o_orderkey AS order_id, CASE o_orderkey % 20 WHEN 0 THEN '0.3.0' WHEN 1 THEN NULL WHEN 2 THEN '0.1.0' ELSE '0.2.0' END AS format_version, CASE o_orderkey % 20 "
       + " ".join(f"WHEN {k} THEN '{reason}'" for k, (_, reason) in FAULTS.items()) + f" END AS reason_code FROM orders WHERE NOT ({SOUND})")
def _(spark, d):
    return V.rejected(_project_documents(spark, d, "reason"), ["o_orderkey"]).withColumnRenamed("o_orderkey", "order_id")


MANIFEST = "run-manifest"


def _manifests(spark, d) -> DataFrame:
    """One manifest for every event, with one to three stage attempts; some of another version, some with a broken stage."""
    reference = "named_struct('role', 'result', 'media_type', 'image/png', 'uri', concat('out/', e, '.png'), 'sha256', sha2(concat(event_id, '.', e), 256), 'byte_length', event_id + e)"
    limits = ", ".join(f"'{n}', {v}" for n, v in (("max_wall_time_ms", "60000"), ("max_cpu_time_ms", "50000"), ("max_peak_ram_bytes", "event_id * 1000"), ("max_scratch_bytes", "0"), ("max_output_bytes", "4096"),
                                                  ("max_output_files", "e"), ("max_peak_vram_bytes", "0"), ("gpu_allowed", "false")))
    enforced = ", ".join(f"'{n}', '{v}'" for n, v in (("output", "hard"), ("scratch", "post-stage-observed"), ("wall_time", "cooperative-post-stage-observed"), ("cpu_time", "post-stage-observed"), ("ram", "unavailable"),
                                                      ("vram", "not-applicable"), ("egress", "not-enforced-in-process")))
    failed = "e = 2 and event_type = 'error'"
    stage = (f"named_struct('id', concat('stage.', e), 'attempt_id', concat('attempt.', event_id, '.', e), 'contract_id', 'contract.a', 'stage_type', concat('kind.', e), 'adapter_id', 'adapter.a', 'implementation_version', '1.0',"
             f" 'producer_kind', 'deterministic', 'determinism', 'byte-exact', 'resolved_stage_spec_sha256', sha2('spec', 256), 'config_sha256', sha2(event_type, 256), 'seed_u64', lpad(event_id, 20, '0'),"
             f" 'input_sha256', array(sha2('a', 256), sha2('b', 256)), 'outputs', if({failed}, array(), array({reference})), 'status', if({failed}, 'failed', 'succeeded'), 'reason_code', if({failed}, 'STAGE_FAILED', null),"
             f" 'finding_codes', if({failed}, array('FINDING_A', 'FINDING_B'), array()), 'duration_ms', event_id % 5000 + e, 'cpu_time_ms', event_id % 4000 + e, 'limits', named_struct({limits}),"
             f" 'enforcement', named_struct({enforced}), 'scratch_cleaned', true)")
    body = (f"to_json(named_struct('format', '{MANIFEST}', 'format_version', if(event_id % 13 = 0, '9.9.9', '0.2.0'), 'scope', 'spike', 'run_id', concat('run.', event_id), 'run_spec_sha256', sha2('s', 256), 'root_seed_u64', lpad(user_id, 20, '0'),"
            f" 'terminal_status', if(event_type = 'error', 'failed', 'succeeded'), 'terminal_reason_code', if(event_type = 'error', 'RUN_FAILED', null), 'stages', transform(sequence(0, cast(event_id % 3 as int)), e -> {stage})))")
    text = f"if(event_id % 17 = 0, replace({body}, '\"duration_ms\":', '\"duration_ms\":\"slow\",\"was\":'), {body})"
    return V.ingest_manifests(I.spread(I.table(spark, d, "events"), "event_id").select("event_id", F.expr(text).alias("value")), "value", MANIFEST)


_FAILED = "e = 2 AND event_type = 'error'"
_STAGES = "(SELECT *, unnest(range(0, event_id % 3 + 1)) AS e FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)"


@query("stage_attempts", "run_id:s position:l id:s attempt_id:s contract_id:s stage_type:s adapter_id:s implementation_version:s producer_kind:s determinism:s resolved_stage_spec_sha256:s config_sha256:s seed_u64:s inputs:s"
       " status:s reason_code:s findings:s duration_ms:l cpu_time_ms:l max_wall_time_ms:l max_peak_ram_bytes:l gpu_allowed:b enforced:s scratch_cleaned:b", f"""
SELECT 'run.' || event_id AS run_id, e AS position, 'stage.' || e AS id, 'attempt.' || event_id || '.' || e AS attempt_id, 'contract.a' AS contract_id, 'kind.' || e AS stage_type, 'adapter.a' AS adapter_id, '1.0' AS implementation_version,
  'deterministic' AS producer_kind, 'byte-exact' AS determinism, sha256('spec') AS resolved_stage_spec_sha256, sha256(event_type) AS config_sha256, lpad(CAST(event_id AS VARCHAR), 20, '0') AS seed_u64, sha256('a') || ',' || sha256('b') AS inputs,
  CASE WHEN {_FAILED} THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN {_FAILED} THEN 'STAGE_FAILED' END AS reason_code, CASE WHEN {_FAILED} THEN 'FINDING_A,FINDING_B' ELSE '' END AS findings,
  event_id % 5000 + e AS duration_ms, event_id % 4000 + e AS cpu_time_ms, 60000 AS max_wall_time_ms, event_id * 1000 AS max_peak_ram_bytes, false AS gpu_allowed, 'hard unavailable not-applicable' AS enforced, true AS scratch_cleaned FROM {_STAGES}""")
def _(spark, d):
    stages = V.part(_manifests(spark, d), "stages", "0.2.0")
    return stages.select("*", F.array_join("input_sha256", ",").alias("inputs"), F.array_join("finding_codes", ",").alias("findings"), "limits.max_wall_time_ms", "limits.max_peak_ram_bytes", "limits.gpu_allowed",
                         F.concat_ws(" ", "enforcement.output", "enforcement.ram", "enforcement.vram").alias("enforced"))


@query("stage_outputs", "run_id:s position:l id:s role:s media_type:s uri:s sha256:s byte_length:l", f"""
SELECT 'run.' || event_id AS run_id, e AS position, 'stage.' || e AS id, 'result' AS role, 'image/png' AS media_type, 'out/' || e || '.png' AS uri, sha256(event_id || '.' || e) AS sha256, event_id + e AS byte_length
FROM {_STAGES} WHERE NOT ({_FAILED})""")
def _(spark, d):
    return V.stage_outputs(V.part(_manifests(spark, d), "stages", "0.2.0"))


@query("rejected_manifests", "event_id:l format_version:s reason_code:s", """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '9.9.9' ELSE '0.2.0' END AS format_version, CASE WHEN event_id % 13 = 0 THEN 'VERSION_UNKNOWN' ELSE 'PART_MALFORMED:stages' END AS reason_code
FROM events WHERE event_id % 13 = 0 OR event_id % 17 = 0""")
def _(spark, d):
    return V.rejected(_manifests(spark, d), ["event_id"])


@query("admit_artifacts", "attempt_id:l position:l name:s decision:s", sql("""
WITH f AS (SELECT user_id AS attempt_id, event_id AS position, CASE WHEN event_id % 19 = 0 THEN 'Bad Name' ELSE 'file-' || event_id % 400 || '.png' END AS name, sha256(props) AS sha, CAST(floor(value * 100) AS BIGINT) AS n FROM events),
m AS (SELECT *, CASE WHEN name = 'Bad Name' THEN 'NAME_NOT_PERMITTED' WHEN position <> min(position) OVER (PARTITION BY attempt_id, name) THEN 'NAME_DUPLICATED' END AS problem FROM f),
r AS (SELECT *, count(*) FILTER (WHERE problem IS NULL) OVER w AS nth, sum(CASE WHEN problem IS NULL THEN n END) OVER w AS bytes FROM m WINDOW w AS (PARTITION BY attempt_id ORDER BY position))
SELECT attempt_id, position, name, CASE WHEN problem IS NOT NULL THEN problem WHEN nth > 40 THEN 'FILE_LIMIT' WHEN bytes > 60000 THEN 'BYTE_LIMIT' WHEN sha IN (SELECT sha256(props) FROM events WHERE event_id % 100 = 0) THEN 'linked' ELSE 'write' END AS decision FROM r"""))
def _(spark, d):
    files = I.table(spark, d, "events").selectExpr(
        "user_id as attempt_id", "event_id as position", "if(event_id % 19 = 0, 'Bad Name', concat('file-', event_id % 400, '.png')) as name", "sha2(props, 256) as sha256", "cast(floor(value * 100) as bigint) as byte_length")
    stored = files.where("position % 100 = 0").select("sha256")
    return W.admit_artifacts(files, stored, 40, 60000)


@query("artifact_round_trip", "sha256:s byte_length:l text_sha256:s", sql("""
SELECT sha256, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS byte_length, sha256 AS text_sha256 FROM (
  SELECT *, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) GROUP BY sha256 HAVING min(doc_id) % 7 <> 0"""))
def _(spark, d):
    """Texts of documents as contents; those whose first document is a multiple of seven are stored already. What was written is read back."""
    docs = I.table(spark, d, "documents").selectExpr("doc_id as payload_id", "sha2(text, 256) as sha256", "encode(text, 'utf-8') as content")
    decided = docs.groupBy("sha256").agg(F.min("payload_id").alias("first")).selectExpr("sha256", "if(first % 7 = 0, 'linked', 'write') as decision")
    folder = f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    W.write_artifacts(decided, docs, folder)
    return W.read_artifacts(spark, folder).select("sha256", F.octet_length("content").alias("byte_length"), F.sha2("content", 256).alias("text_sha256"))


@query("report_rows", "line:s", sql("""
SELECT '{"blocking":' || b || ',"detail":{"a":' || a || ',"z":"' || z || '"},"project_id":' || p || '}' AS line FROM (
  SELECT l_orderkey AS p, count(*) FILTER (WHERE l_returnflag = 'R') AS b, min(l_partkey) AS a, max(l_linestatus) AS z FROM lineitem GROUP BY 1)"""))
def _(spark, d):
    facts = I.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(
        F.struct(F.max("l_linestatus").alias("z"), F.min("l_partkey").alias("a")).alias("detail"), F.count_if(F.col("l_returnflag") == "R").alias("blocking"))
    return facts.select(W.sorted_json(facts).alias("line"))


@query("newest_bundles", "bundle_id:l modified:s", sql("""
SELECT c_custkey AS bundle_id, strftime(max(o_orderdate), '%Y-%m-%d') AS modified FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING bool_and(o_totalprice > 3000)"""))
def _(spark, d):
    orders = I.table(spark, d, "orders")
    bundles = orders.groupBy(F.col("o_custkey").alias("bundle_id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("modified"))
    verdicts = orders.groupBy(F.col("o_custkey").alias("bundle_id")).agg(F.min(F.expr("o_totalprice > 3000")).alias("verified"))
    return S.newest_verified(bundles, verdicts)


@query("registry_domain_errors", "entry_id:l reason:s", sql("""
SELECT p_partkey AS entry_id, CASE WHEN low >= high THEN 'EMPTY_RANGE' WHEN neutral < low OR neutral > high THEN 'NEUTRAL_OUTSIDE' WHEN p_partkey % 77 = 0 THEN 'BAD_CAPABILITY' WHEN p_partkey % 5 = 0 THEN 'NOT_MANUAL' END AS reason
FROM (SELECT p_partkey, p_size - 5 AS low, p_size + p_partkey % 9 - 5 AS high, p_size - 1 AS neutral FROM part) WHERE reason IS NOT NULL"""))
def _(spark, d):
    rows = I.table(spark, d, "part").selectExpr(
        "p_partkey as entry_id", "cast(p_size - 5 as double) as low", "cast(p_size + p_partkey % 9 - 5 as double) as high", "cast(p_size - 1 as double) as neutral",
        "if(p_partkey % 77 = 0, 'mystery', 'candidate_optional') as capability", "p_partkey % 5 <> 0 as manual")
    return R.parameter_domain_errors(rows)
