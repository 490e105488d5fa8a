"""Registries as small dimensions: built-in fixed values or JSON files, with value-domain checks.

Their row counts are fixed by the registry version (16 slots, 10 parameters), which is the bound that allows them to
be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

SLOT_SCHEMA = "slot_index int, slot_id string, parent string, side string, cardinality string, applicability string"
PARAMETER_SCHEMA = ("parameter_index int, parameter_id string, capability string, low double, high double, neutral double,"
                    " manual boolean, tracking boolean")


def slots(spark: SparkSession, namespace: str = "") -> DataFrame:
    """Built-in ontology; ``namespace`` is put before every slot id (for example ``"xyz."``)."""
    named = lambda s: None if s is None else namespace + s
    rows = [(i, named(s), named(p), side, card, app) for i, (s, p, side, card, app) in enumerate(fixed.SLOTS)]
    return spark.createDataFrame(rows, SLOT_SCHEMA)


def parameters(spark: SparkSession) -> DataFrame:
    rows = [(i, p, cap, lo, hi, n, True, tr) for i, (p, cap, lo, hi, n, tr) in enumerate(fixed.PARAMETERS)]
    return spark.createDataFrame(rows, PARAMETER_SCHEMA)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Slots of ontology registry files: one row per (registry file, slot)."""
    schema = (
        "registry string, version string, slots array<struct<id: string, parent: string, side: string, cardinality: string, applicability: string>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select("version", F.posexplode("slots").alias("slot_index", "s")).select(
        "version", "slot_index", F.col("s.id").alias("slot_id"), "s.parent", "s.side", "s.cardinality", "s.applicability")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "registry string, version string, parameters array<struct<id: string, capability: string, unit: string,"
        " template_range: array<double>, neutral: double, sign: string, roles: array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select("version", F.posexplode("parameters").alias("parameter_index", "p")).select(
        "version", "parameter_index", F.col("p.id").alias("parameter_id"), "p.capability",
        F.expr("p.template_range[0]").alias("low"), F.expr("p.template_range[1]").alias("high"), "p.neutral",
        F.coalesce(F.array_contains("p.roles", "manual"), F.lit(False)).alias("manual"),
        F.coalesce(F.array_contains("p.roles", "tracking"), F.lit(False)).alias("tracking"))


def slot_domain_errors(slots: DataFrame) -> DataFrame:
    """Value-domain violations of an ontology table."""
    reason = F.expr(
        "case when slot_id is null or not slot_id rlike '^[a-z][a-z0-9_.-]{2,127}$' then 'BAD_ID'"
        " when side is not null and side not in ('left', 'right', 'center') then 'BAD_SIDE'"
        " when cardinality not in ('exactly_one', 'zero_or_one', 'zero_or_many') then 'BAD_CARDINALITY'"
        " when applicability not in ('required', 'conditional', 'optional') then 'BAD_APPLICABILITY' end"
    )
    return slots.withColumn("reason", reason).where("reason is not null")


def parameter_domain_errors(parameters: DataFrame) -> DataFrame:
    """Value-domain violations of a parameter table: range order, neutral inside it, known capability, manual role."""
    reason = F.expr(
        "case when low is null or high is null or neutral is null or isnan(low) or isnan(high) or isnan(neutral) then 'NOT_FINITE'"
        " when low >= high then 'EMPTY_RANGE' when neutral < low or neutral > high then 'NEUTRAL_OUTSIDE'"
        " when capability not in ('candidate_mandatory', 'candidate_optional', 'research_optional') then 'BAD_CAPABILITY'"
        " when not manual then 'NOT_MANUAL' end"
    )
    return parameters.withColumn("reason", reason).where("reason is not null")


# The two axes of a reason-code registry and the severities of its findings.
REASON_AXES = ("operational_causes", "quality_findings")
SEVERITIES = ("info", "review", "blocking")
_CAUSE = ("array<struct<id: string, severity: string, message_key: string, owner: string, applies_to: string, outcome_field: string, outcome: string, retryable: boolean, creates_run: boolean,"
          " http_problem_code: string, telemetry_category: string, user_action: string>>")
_FINDING = "array<struct<id: string, severity: string, message_key: string, owner: string, category: string, repair: string>>"


def read_reason_codes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of the reason-code registry files: (registry, version, axis, position, id, severity, message_key, owner, ...).

    An axis that is missing gives one row with a null position, so that ``reason_code_errors`` sees it.
    """
    schema = f"registry string, version string, operational_causes {_CAUSE}, quality_findings {_FINDING}"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    shared = ("id", "severity", "message_key", "owner")
    out = []
    for axis, own in zip(REASON_AXES, (("applies_to", "outcome_field", "outcome", "retryable", "user_action"), ("category", "repair")), strict=True):
        rows = raw.select("registry", "version", F.lit(axis).alias("axis"), F.posexplode_outer(axis).alias("position", "e"), F.col(axis).isNull().alias("missing"))
        rows = rows.where("missing or position is not null")
        out.append(rows.select("registry", "version", "axis", "position", *[F.col(f"e.{f}").alias(f) for f in (*shared, *own)]))
    return out[0].unionByName(out[1], allowMissingColumns=True)


def reason_code_errors(entries: DataFrame) -> DataFrame:
    """Violations in reason-code registries ``(registry, version, axis, position, id, severity)``: a missing axis, an entry without an id, an
    id that occurs twice on either axis, a finding of unknown severity; (registry, version, axis, position, id, reason)."""
    keys = ["registry", "version"]
    sides = entries.groupBy(*keys).agg(*[F.max((F.col("axis") == axis) & F.col("position").isNotNull()).alias(axis) for axis in REASON_AXES])
    absent = F.explode(F.filter(F.array(*[F.when(~F.col(axis), F.lit(axis)) for axis in REASON_AXES]), lambda a: a.isNotNull()))
    missing = sides.select(*keys, absent.alias("axis")).select(*keys, "axis", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("id"), F.lit("AXIS_MISSING").alias("reason"))
    listed = entries.where("position is not null")
    uses = listed.where("id is not null").groupBy(*keys, "id").agg(F.count("*").alias("uses"))
    reason = F.expr("case when id is null then 'ENTRY_MALFORMED' when uses > 1 then 'ID_DUPLICATED'"
                    f" when axis = '{REASON_AXES[1]}' and not coalesce(severity in {SEVERITIES}, false) then 'SEVERITY_UNSUPPORTED' end")
    judged = listed.join(uses, [*keys, "id"], "left").withColumn("reason", reason).where("reason is not null")
    return judged.select(*keys, "axis", "position", "id", "reason").unionByName(missing)
