"""Referential integrity and rule checks over project tables: duplicates, references, roles, parameters, status.

Every rule is an equi-join, an anti-join or a combinable aggregate keyed by project and id. Finding rows carry
``code``, ``severity`` and ``instance_id`` so the rules can be unioned and rolled up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def duplicate_ids(entities: DataFrame) -> DataFrame:
    """Ids that occur more than once inside one (project, collection)."""
    return entities.groupBy("project_id", "kind", "id").count().where("count > 1").withColumnRenamed("count", "copies")


def cross_kind_collisions(entities: DataFrame) -> DataFrame:
    """Ids used more than once in a project whatever their kind (parameters have their own namespace)."""
    counted = entities.where("kind <> 'parameters'").groupBy("project_id", "id").agg(
        F.count("*").alias("uses"), F.min("kind").alias("first_kind"), F.max("kind").alias("last_kind"))
    return counted.where("uses > 1").select("project_id", "id", "uses", (F.col("first_kind") != F.col("last_kind")).alias("across_kinds"))


def unresolved_references(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges ``(project_id, edge, owner_id, target_id)`` whose target is not declared for that edge kind.

    The target side is reduced to distinct keys first, so copies of one target cannot build a hot join partition.
    """
    known = targets.select("project_id", "edge", F.col("id").alias("target_id")).distinct()
    return edges.join(known, ["project_id", "edge", "target_id"], "left_anti")


def wrong_roles(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References ``(project_id, owner_id, artifact_id, expected_role)`` that resolve to an artifact of another role."""
    roles = artifacts.groupBy("project_id", "artifact_id").agg(F.min("role").alias("role"))
    allowed = reduce(
        lambda a, b: a | b,
        [(F.col("role") == declared) & (F.col("expected_role") == serves) for declared, serves in fixed.INTERCHANGEABLE_ROLES],
    )
    return references.join(roles, ["project_id", "artifact_id"]).where((F.col("role") != F.col("expected_role")) & ~allowed)


def draw_order_clashes(layers: DataFrame) -> DataFrame:
    """Projects whose layers do not all have distinct draw orders; two combinable aggregates instead of a distinct count."""
    per_order = layers.groupBy("project_id", "draw_order").agg(F.count("*").alias("n"))
    per_project = per_order.groupBy("project_id").agg(F.sum("n").alias("layers"), F.count("*").alias("distinct_orders"))
    return per_project.where("layers <> distinct_orders")


def artifact_errors(artifacts: DataFrame, payloads: DataFrame) -> DataFrame:
    """Verify ``(id, sha256, byte_length)`` against stored bytes: presence, digest, length, content address."""
    checked = artifacts.join(payloads.select("payload_key", "content"), "payload_key", "left")
    reason = F.expr(
        "case when content is null then 'BYTES_MISSING' when not (sha2(content, 256) <=> sha256) then 'DIGEST_MISMATCH'"
        " when not (octet_length(content) <=> byte_length) then 'LENGTH_MISMATCH'"
        " when not (id <=> concat('sha256:', sha256)) then 'NOT_CONTENT_ADDRESS' end"
    )
    return checked.withColumn("reason", reason).where("reason is not null").drop("content")


def ontology_findings(projects: DataFrame, recorded: DataFrame, slot_ids: list[str]) -> DataFrame:
    """Missing, low-confidence and unknown slots per project: every (project, slot) against the recorded rows.

    The slot list is a fixed registry (16 ids), exploded from one array literal per project.
    """
    listed = F.array(*[F.lit(s) for s in slot_ids])
    expected = projects.select("project_id", F.explode(listed).alias("slot_id"), F.lit(True).alias("known"))
    unique = recorded.groupBy("project_id", "slot_id").agg(F.min("status").alias("status"))
    joined = expected.join(unique, ["project_id", "slot_id"], "full")
    finding = F.expr(
        "case when known is null then 'ontology-unknown' when status is null then 'ontology-missing'"
        " when status = 'LOW_CONFIDENCE' then 'ontology-low-confidence' end"
    )
    severity = F.expr("if(finding = 'ontology-low-confidence', 'review', 'blocking')")
    return joined.withColumn("finding", finding).where("finding is not null").withColumn("severity", severity).select(
        "project_id", "finding", "severity", "slot_id")


def parameter_findings(parameters: DataFrame, registry: DataFrame, bound: DataFrame) -> DataFrame:
    """Range order, registry range, neutral value, manual operation and binding of every parameter."""
    reg = registry.select("parameter_id", "low", "high", "neutral")
    bindings = bound.select("project_id", "parameter_id").distinct().withColumn("is_bound", F.lit(True))
    joined = parameters.join(F.broadcast(reg), "parameter_id").join(bindings, ["project_id", "parameter_id"], "left")
    mandatory = "capability = 'candidate_mandatory'"
    rules = (
        ("parameter-range", "not (minimum <= safe_minimum and safe_minimum <= default_value and default_value <= safe_maximum and safe_maximum <= maximum)"),
        ("parameter-registry-range", "minimum < low or maximum > high"),
        ("parameter-neutral", "neutral <> default_value"),
        ("parameter-manual", f"{mandatory} and not manual_enabled"),
        ("parameter-unbound", f"{mandatory} and is_bound is null"),
    )
    found = F.array_compact(F.array(*[F.when(F.expr(condition), name) for name, condition in rules]))
    return joined.select("project_id", "parameter_id", F.explode(found).alias("finding"))


def layers_without_mesh(layers: DataFrame, meshes: DataFrame) -> DataFrame:
    with_mesh = meshes.select("project_id", F.col("layer_id").alias("id")).distinct()
    return layers.join(with_mesh, ["project_id", "id"], "left_anti")


def unknown_reason_codes(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Codes in use that no registry axis declares, with their number of uses; codes are counted before the join."""
    used = findings.groupBy("code").agg(F.count("*").alias("uses"))
    return used.join(registry.select(F.col("id").alias("code")).distinct(), "code", "left_anti")


def unresolved_codes(used: DataFrame, registry: DataFrame, axis: str) -> DataFrame:
    """Codes in use (code) that ``registry`` (id, axis) does not have on ``axis``: problem UNKNOWN or WRONG_AXIS, and the number of uses."""
    counted = used.groupBy("code").agg(F.count("*").alias("uses"))
    axes = registry.groupBy(F.col("id").alias("code")).agg(F.max(F.col("axis") == axis).alias("there"))
    problem = F.expr("case when there is null then 'UNKNOWN' when not there then 'WRONG_AXIS' end")
    return counted.join(axes, "code", "left").withColumn("problem", problem).where("problem is not null").select("code", "problem", "uses")


def codes_on_both_axes(registry: DataFrame) -> DataFrame:
    return registry.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def report_status(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Blocked over pass_with_review over pass, plus counts; projects without findings pass."""
    counts = findings.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "review").alias("review"))
    joined = projects.select("project_id").join(counts, "project_id", "left").na.fill(0, ["blocking", "review"])
    status = F.expr("case when blocking > 0 then 'blocked' when review > 0 then 'pass_with_review' else 'pass' end")
    return joined.withColumn("status", status)


def geometry_candidates(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Projects that nothing blocks yet: only these go through the expensive geometry and pixel checks."""
    blocked = findings.where("severity = 'blocking'").select("project_id").distinct()
    return projects.join(blocked, "project_id", "left_anti")


def provenance_errors(rows: DataFrame) -> DataFrame:
    """Deterministic producers carry no model field; model-backed producers need all five."""
    fields = ("model_id", "model_weights_sha256", "model_license_record_id", "execution_provider", "precision")
    present = " + ".join(f"cast({f} is not null as int)" for f in fields)
    reason = F.expr(
        f"case when producer_kind = 'deterministic' and {present} > 0 then 'DETERMINISTIC_HAS_MODEL_FIELD'"
        f" when producer_kind = 'model_backed' and {present} < {len(fields)} then 'MODEL_FIELD_MISSING'"
        " when producer_kind not in ('deterministic', 'model_backed') then 'UNKNOWN_PRODUCER' end"
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def structure_mismatches(main: DataFrame, depth: DataFrame, metadata: DataFrame) -> DataFrame:
    """Positions at which the main and depth panels differ or whose metadata is invalid, and metadata that no layer has.

    ``main`` and ``depth``: (doc_id, position, name, left, top, right, bottom); ``metadata``: (doc_id, name, tag, box, depth_median, part_id),
    ``part_id`` null where there is none. Metadata without a layer has the reason LAYER_MISSING and no position.
    """
    shape = F.struct("name", "left", "top", "right", "bottom")
    l = main.select("doc_id", "position", shape.alias("m"))
    r = depth.select("doc_id", "position", shape.alias("d"))
    panels = l.join(r, ["doc_id", "position"], "full").withColumn("name", F.coalesce("m.name", "d.name"))
    meta = metadata.select("doc_id", "name", "tag", "box", "depth_median", "part_id", F.lit(True).alias("described"))
    joined = panels.join(meta, ["doc_id", "name"], "full")
    reason = F.expr(
        "case when position is null then 'LAYER_MISSING' when not (m <=> d) then 'PANELS_DIFFER' when described is null then 'METADATA_MISSING' when not (tag <=> m.name) then 'TAG_MISMATCH'"
        " when not (box <=> array(m.left, m.top, m.right, m.bottom)) then 'BOX_MISMATCH'"
        " when depth_median is null or isnan(depth_median) or depth_median < 0 or depth_median > 1 then 'DEPTH_MEDIAN_INVALID' when part_id < 0 then 'PART_ID_INVALID' end"
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("doc_id", "position", "name", "reason")


def stats_errors(stats: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Run statistics must be finite and non-negative, and the total at least the sum of its parts."""
    every = [*parts, total]
    bad = " or ".join(f"{c} is null or isnan({c}) or abs({c}) = double('infinity') or {c} < 0" for c in every)
    reason = F.expr(f"case when {bad} then 'NOT_A_MEASUREMENT' when {total} < {' + '.join(parts)} then 'TOTAL_BELOW_PARTS' end")
    return stats.withColumn("reason", reason).where("reason is not null")


def registry_drift(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves ``(keys, path, value)`` that were added, removed or changed between two registry versions."""
    l = left.select(*keys, "path", F.col("value").alias("old_value"), F.lit(True).alias("in_old"))
    r = right.select(*keys, "path", F.col("value").alias("new_value"), F.lit(True).alias("in_new"))
    joined = l.join(r, [*keys, "path"], "full")
    change = F.expr(
        "case when in_old is null then 'added' when in_new is null then 'removed' when not (old_value <=> new_value) then 'changed' end"
    )
    return joined.withColumn("change", change).where("change is not null").select(*keys, "path", "old_value", "new_value", "change")


def leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """Flatten the scalar and nested-struct columns of a table to ``(keys, path, value)`` rows."""
    paths: list[str] = []

    def walk(prefix: str, schema) -> None:
        for field in schema.fields:
            path = f"{prefix}{field.name}"
            if hasattr(field.dataType, "fields"):
                walk(path + ".", field.dataType)
            elif path not in keys:
                paths.append(path)

    walk("", df.schema)
    entries = F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in paths])
    return df.select(*keys, F.inline(entries))


def digest_bindings(packages: DataFrame, records: DataFrame, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Report, run-manifest and release records must carry the package's payload digest and revision.

    ``packages``: (package_id, payload_sha256, revision_id); ``records``: (package_id, kind, payload_sha256, revision_id). With ``digest``
    both hold a ``payload`` shorter than its digest instead, and it is digested where rows have met, so no digest is shuffled.
    """
    carried, shown = ("payload_sha256", lambda c: c) if digest is None else ("payload", digest)
    p = packages.select("package_id", F.col(carried).alias("expected"), F.col("revision_id").alias("expected_revision"))
    met = records.join(p, "package_id", "left").withColumn("expected", shown(F.col("expected"))).withColumn("payload_sha256", shown(F.col(carried)))
    reason = F.expr(
        "case when expected is null then 'NO_PACKAGE' when not (payload_sha256 <=> expected) then 'PAYLOAD_DIGEST_MISMATCH'"
        " when kind = 'run_manifest' and not (revision_id <=> expected_revision) then 'REVISION_MISMATCH' end"
    )
    return met.withColumn("reason", reason).where("reason is not null")


def legacy_project_errors(layers: DataFrame, artifacts: DataFrame, deformers: DataFrame, meshes: DataFrame, bindings: DataFrame,
                          parameters: DataFrame) -> DataFrame:
    """First-format projects: artifact references, deformer parents and targets, pose-binding artifact and parameter keys.

    Map keys are exploded to edges, so a binding with many samples is checked by the same anti-join as everything else.
    """
    def edges(df: DataFrame, rule: str, owner: str, target: Column) -> DataFrame:
        return df.select("project_id", F.lit(rule).alias("edge"), F.col(owner).alias("owner_id"), target.alias("target_id")).where("target_id is not null")

    def known(df: DataFrame, rule: str) -> DataFrame:
        return df.select("project_id", F.lit(rule).alias("edge"), "id")

    every_edge = reduce(DataFrame.unionByName, [
        edges(layers, "layer-artifact", "id", F.col("texture_artifact_id")),
        edges(deformers, "deformer-parent", "id", F.col("parent_id")),
        edges(deformers.select("project_id", "id", F.explode("target_ids").alias("target")), "deformer-target", "id", F.col("target")),
        edges(bindings, "binding-artifact", "id", F.col("artifact_id")),
        edges(bindings.select("project_id", "id", F.explode(F.map_keys("parameter_samples")).alias("key")), "binding-parameter", "id", F.col("key")),
    ])
    targets = reduce(DataFrame.unionByName, [
        known(artifacts, "layer-artifact"), known(artifacts, "binding-artifact"), known(deformers, "deformer-parent"),
        known(deformers, "deformer-target"), known(meshes, "deformer-target"), known(parameters, "binding-parameter"),
    ])
    return unresolved_references(every_edge, targets)
