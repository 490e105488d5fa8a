"""Versioned project documents and run manifests: VARIANT in, typed tables out, one projection for each format version.

A document is parsed once into a VARIANT. Its ``format_version`` picks the projection; a document that cannot be read, has another format,
an unknown version, or a part that does not fit its projection gives no rows in any table, only a row with the reason. So a new version
is never half read by the layout of an old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Field names of the two document formats, in the order of their schemas.
BOUNDS = "struct<x: double, y: double, width: double, height: double, unit: string, space: string>"
PROJECT_PARTS = {
    "0.2.0": {
        "ontology_completion": "slot_id string, status string, instance_ids array<string>, confidence_fact_ids array<string>, reason_codes array<string>, evidence_artifact_ids array<string>",
        "artifacts": "id string, uri string, sha256 string, byte_length bigint, media_type string, role string, sensitivity string",
        "confidence_facts": "id string, target_id string, score string, calibration_dataset_id string, calibration_method string, calibration_version string, threshold_band string,"
                            " evidence_artifact_ids array<string>, provenance_id string",
        "layers": f"id string, display_name string, slot_id string, side string, texture_artifact_id string, bounds {BOUNDS}, visible boolean, opacity double, blend_mode string, draw_order int",
        "generated_regions": f"id string, owner_layer_id string, mask_artifact_id string, reveal_bounds {BOUNDS}, feather_width_px double, confidence_fact_id string, provenance_id string",
        "meshes": "id string, layer_id string, vertex_payload_artifact_id string, vertex_payload_format string, index_payload_artifact_id string, index_payload_format string, vertex_count int,"
                  " triangle_count int, winding string",
        "parameters": "id string, capability string, minimum double, `default` double, maximum double, safe_minimum double, safe_maximum double, clamp boolean, manual_enabled boolean, tracking_enabled boolean",
        "bindings": "id string, parameter_id string, target_mesh_id string, samples array<struct<parameter_value: double, delta_artifact_id: string, delta_format: string>>, interpolation string, extrapolation string",
        "provenance": "id string, producer_kind string, stage_id string, implementation_version string, config_sha256 string, seed_u64 string, input_sha256 array<string>, model_id string,"
                      " model_weights_sha256 string, model_license_record_id string, execution_provider string, precision string",
        "user_overrides": "id string, target_id string, operation string, parent_revision_id string, created_at string, replay_attempt_id string, replay_status string, reason_code string,"
                          " mask_artifact_id string, mask_format string, new_draw_order int, safe_minimum double, safe_maximum double, replacement_artifact_id string",
    },
    "0.1.0": {
        "artifacts": "id string, uri string, sha256 string, byte_length bigint, media_type string, role string, sensitivity string, producer_stage_result_id string",
        "layers": "id string, name string, semantic string, side string, instance_index int, parent_layer_id string, bounds struct<x: double, y: double, width: double, height: double>,"
                  " texture_artifact_id string, visible_mask_artifact_id string, generated_mask_artifact_id string, generation_mode string, confidence double, fallback_mode string",
        "occlusion_edges": "behind_layer_id string, in_front_layer_id string, source string, confidence double",
        "meshes": "id string, layer_id string, vertex_payload_artifact_id string, index_payload_artifact_id string, vertex_count int, triangle_count int, index_type string, winding string, deformer_ids array<string>",
        "parameters": "id string, unit string, minimum double, `default` double, maximum double",
        "deformers": "id string, type string, parent_deformer_id string, target_ids array<string>, `order` int, payload_artifact_id string",
        "user_overrides": "id string, target_id string, operation string, data_artifact_id string, created_at string, parent_revision string",
    },
}
PROJECT_HEADS = {
    "0.2.0": "project_id string, revision_id string, parent_revision_id string, created_at string, canvas struct<width: int, height: int, image_origin: string, color_space: string, alpha_mode: string>,"
             " ontology_registry_version string, reason_code_registry struct<id: string, version: string, sha256: string>, parameter_registry struct<id: string, version: string, sha256: string>",
    "0.1.0": "project_id string, created_at string, canvas struct<width: int, height: int, image_origin: string, color_space: string, alpha_mode: string>",
}
FILE_REFERENCE = "struct<role: string, media_type: string, uri: string, sha256: string, byte_length: bigint>"
MANIFEST_PARTS = {
    "0.2.0": {
        "stages": "id string, attempt_id string, contract_id string, stage_type string, adapter_id string, implementation_version string, producer_kind string, determinism string,"
                  f" resolved_stage_spec_sha256 string, config_sha256 string, seed_u64 string, input_sha256 array<string>, outputs array<{FILE_REFERENCE}>, status string, reason_code string,"
                  " finding_codes array<string>, duration_ms bigint, cpu_time_ms bigint, limits struct<max_wall_time_ms: bigint, max_cpu_time_ms: bigint, max_peak_ram_bytes: bigint,"
                  " max_scratch_bytes: bigint, max_output_bytes: bigint, max_output_files: bigint, max_peak_vram_bytes: bigint, gpu_allowed: boolean>,"
                  " enforcement struct<output: string, scratch: string, wall_time: string, cpu_time: string, ram: string, vram: string, egress: string>, scratch_cleaned boolean",
    },
    "0.1.0": {
        "stages": "id string, stage_type string, producer_kind string, implementation_version string, config_sha256 string, seed_u64 string, input_sha256 array<string>, output_sha256 array<string>,"
                  " status string, determinism string, duration_ms bigint, peak_ram_bytes bigint, peak_vram_bytes bigint, finding_codes array<string>, model_id string, model_weights_sha256 string,"
                  " model_license_record_id string",
    },
}
MANIFEST_HEADS = {
    "0.2.0": "scope string, run_id string, run_spec_sha256 string, root_seed_u64 string, started_at string, completed_at string, terminal_status string, terminal_reason_code string,"
             " application struct<version: string, build_id: string, source_revision: string>, environment struct<os: string, cpu: string, python: string, python_implementation: string,"
             f" execution_provider: string, execution_profile: string, precision: string>, source {FILE_REFERENCE}, result {FILE_REFERENCE}",
    "0.1.0": "run_id string, project_revision_id string, project_payload_sha256 string, started_at string, completed_at string, source_sha256 string",
}
#: Parts that may be absent, by format version; all others must be there, if only as an empty array.
OPTIONAL = {"0.1.0": ("user_overrides",), "0.2.0": ()}
#: Head fields that name a document in its child tables.
KEYS = ("project_id", "revision_id", "run_id")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def _fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of the top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, char in enumerate(ddl + ","):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append((name.strip("`"), kind))
            start = i + 1
    return out


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"`{name}`: {kind}" for name, kind in _fields(ddl)) + ">"


def _checked(kind: str) -> str | None:
    """The least type that a value of ``kind`` must be cast to so as to know that it fits; None for texts, which every value can be read as.

    A list fits if it is an array and a struct if it is an object, whatever is in them.
    """
    if kind == "string":
        return None
    if kind.startswith("array<"):
        return "array<variant>"
    return f"struct<`{_fields(kind[7:-1].replace(':', ' '))[0][0]}`: variant>" if kind.startswith("struct<") else kind


def ingest(texts: DataFrame, column: str, format_name: str, heads: dict[str, str], parts: dict[str, dict[str, str]], keep: tuple[str, ...] | None = None) -> DataFrame:
    """``texts`` with ``format_version``, ``reason_code`` and, for accepted documents, ``head`` and ``part`` structs by version.

    ``reason_code`` is null where the document is accepted, else DOCUMENT_UNREADABLE, FORMAT_UNKNOWN, VERSION_UNKNOWN, HEAD_MALFORMED, or
    PART_MALFORMED:<name> for the first part, in the order of its projection, that is missing, is no array, holds a value that does not
    fit its type, or an element without its id. Every part is checked in full, but of a checked part only the ids and the values that
    might not fit are looked at. ``keep`` names the parts that will be read (``head``: all fields of the head), by default all; only these
    are typed. The typed columns are written once as a nested table, of which every child table then reads its own columns only.
    """
    doc = texts.withColumn("__doc", F.try_parse_json(F.col(column)))
    at = lambda path, kind: f"try_variant_get(__doc, '$.{path}', '{kind}')"
    doc = doc.withColumns({"__format": F.expr(at("format", "string")), "format_version": F.expr(at("format_version", "string"))})
    columns, checks, reasons = {}, {}, []
    for version, named in parts.items():
        mine, tag = f"format_version = '{version}'", version.replace(".", "_")
        read = [(n, k) for n, k in _fields(heads[version]) if keep is None or "head" in keep or n in KEYS]
        columns[f"head_{tag}"] = F.expr(f"if({mine}, named_struct(" + ", ".join(f"'{n}', {at(n, k)}" for n, k in read) + "), null)")
        first = _fields(heads[version])[0][0] if version != "0.2.0" or "scope" not in heads[version] else "run_id"
        reasons.append(f"when {mine} and head_{tag}.{first} is null then 'HEAD_MALFORMED'")
        for name, ddl in named.items():
            key, fit = _fields(ddl)[0][0], {n: _checked(k) for n, k in _fields(ddl) if _checked(k)}
            raw = at(name, "array<struct<" + ", ".join(f"`{n}`: variant" for n in (key, *fit)) + ">>")
            unfit = "".join(f" or (r.`{n}` is not null and not is_variant_null(r.`{n}`) and try_variant_get(r.`{n}`, '$', '{k}') is null)" for n, k in fit.items())
            checks[f"unfit_{name}_{tag}"] = F.expr(f"if({mine}, coalesce(exists({raw}, r -> r is null or r.{key} is null or is_variant_null(r.{key}){unfit}), true), null)")
            absent = f"{at(name, 'variant')} is null" if name in OPTIONAL[version] else "false"
            reasons.append(f"when {mine} and not ({absent}) and unfit_{name}_{tag} then 'PART_MALFORMED:{name}'")
            if keep is None or name in keep:
                columns[f"{name}_{tag}"] = F.expr(f"if({mine}, {at(name, 'array<' + _struct(ddl) + '>')}, null)")
    known = ", ".join(f"'{v}'" for v in parts)
    reason = F.expr(
        f"case when __doc is null then 'DOCUMENT_UNREADABLE' when __format is null or __format <> '{format_name}' then 'FORMAT_UNKNOWN'"
        f" when format_version is null or format_version not in ({known}) then 'VERSION_UNKNOWN' {' '.join(reasons)} end")
    typed = doc.withColumns(columns | checks).withColumn("reason_code", reason)
    return cut(typed.drop("__doc", "__format", column, *checks))


def ingest_projects(texts: DataFrame, column: str, format_name: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    return ingest(texts, column, format_name, PROJECT_HEADS, PROJECT_PARTS, keep)


def ingest_manifests(texts: DataFrame, column: str, format_name: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    return ingest(texts, column, format_name, MANIFEST_HEADS, MANIFEST_PARTS, keep)


def rejected(ingested: DataFrame, keys: list[str]) -> DataFrame:
    """One row for every document that gives no rows: its keys, its version and why."""
    return ingested.where("reason_code is not null").select(*keys, "format_version", "reason_code")


def heads(ingested: DataFrame, version: str) -> DataFrame:
    """One row for every accepted document of a version."""
    tag = version.replace(".", "_")
    return ingested.where(f"reason_code is null and format_version = '{version}'").select(f"head_{tag}.*")


def part(ingested: DataFrame, name: str, version: str) -> DataFrame:
    """Rows of one part of the accepted documents of a version, under the document's identifiers.

    A confidence of ``unavailable`` becomes a null ``score`` with ``score_available`` false; any other text is no number, and null too.
    """
    tag = version.replace(".", "_")
    good = ingested.where(f"reason_code is null and format_version = '{version}'")
    keys = [c for c in KEYS if c in good.schema[f"head_{tag}"].dataType.names]
    rows = good.select(*[F.col(f"head_{tag}.{k}").alias(k) for k in keys], F.posexplode(f"{name}_{tag}").alias("position", "row"))
    rows = rows.select(*keys, "position", "row.*")
    if name == "confidence_facts":
        rows = rows.withColumn("score_available", F.col("score") != "unavailable").withColumn("score", F.expr("try_cast(score as double)"))
    return rows


def project_tables(ingested: DataFrame, version: str = "0.2.0") -> dict[str, DataFrame]:
    """All child tables of a version."""
    return {name: part(ingested, name, version) for name in PROJECT_PARTS[version]}


def stage_outputs(stages: DataFrame) -> DataFrame:
    """(run_id, position, id, file reference) of every output of every stage attempt."""
    return stages.select("run_id", "position", "id", F.inline("outputs"))
