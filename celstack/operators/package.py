"""Package, inventory and bundle reconciliation over member tables; no archive is opened here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import hotkeys

MAX_NAME_BYTES = 255
MAX_DEPTH = 4


def member_path_errors(members: DataFrame) -> DataFrame:
    """Unsafe member paths with the first rule they break."""
    reason = F.expr(rf"""
        case when path = '' or path rlike r'^\s|\s$' then 'EMPTY_OR_PADDED'
             when octet_length(encode(path, 'utf-8')) > {MAX_NAME_BYTES} then 'TOO_LONG'
             when startswith(path, '/') or endswith(path, '/') then 'NOT_RELATIVE'
             when contains(path, '\\') then 'BACKSLASH'
             when substring(path, 2, 1) = ':' then 'DRIVE_LETTER'
             when size(split(path, '/')) > {MAX_DEPTH} then 'TOO_DEEP'
             when exists(split(path, '/'), s -> s in ('', '.', '..')) then 'TRAVERSAL'
             when exists(split(path, '/'), s -> not s rlike r'^[\p{{L}}\p{{N}}._-]+$') then 'BAD_CHARACTER' end""")
    return members.withColumn("reason", reason).where("reason is not null")


def path_collisions(members: DataFrame) -> DataFrame:
    """Lower-cased paths used more than once in a package, telling exact duplicates from case collisions."""
    exact = members.groupBy("package_id", "path").agg(F.count("*").alias("n"))
    folded = exact.groupBy("package_id", F.lower("path").alias("folded")).agg(
        F.sum("n").alias("uses"), F.max("n").alias("most_copies"), F.count("*").alias("spellings"))
    kind = F.expr("case when most_copies > 1 and spellings > 1 then 'both' when spellings > 1 then 'case' else 'exact' end")
    return folded.where("uses > 1").select("package_id", "folded", "uses", kind.alias("kind"))


def package_budgets(members: DataFrame, max_members: int, max_member_bytes: int, max_total_bytes: int, max_ratio: int) -> DataFrame:
    """Totals per package and the ordered list of limits it breaks."""
    ratio = F.expr("if(compressed_length > 0, byte_length / compressed_length, 0.0D)")
    totals = members.groupBy("package_id").agg(
        F.count("*").alias("members"), F.max("byte_length").alias("largest"), F.sum("byte_length").alias("total"), F.max(ratio).alias("ratio"))
    broken = F.array_compact(F.array(
        F.when(F.col("members") > max_members, "MEMBER_COUNT"), F.when(F.col("largest") > max_member_bytes, "MEMBER_BYTES"),
        F.when(F.col("total") > max_total_bytes, "TOTAL_BYTES"), F.when(F.col("ratio") > max_ratio, "COMPRESSION_RATIO")))
    return totals.withColumn("violations", broken)


def index_differences(index: DataFrame, members: DataFrame, index_name: str) -> DataFrame:
    """The index must cover every member except itself, in both directions, with equal length and digest."""
    left = index.groupBy("package_id", "path").agg(
        F.count("*").alias("entries"), F.lit(True).alias("listed"), F.min("byte_length").alias("index_length"), F.min("sha256").alias("index_sha"))
    right = members.where(F.col("path") != index_name).select(
        "package_id", "path", F.col("byte_length").alias("member_length"), F.col("sha256").alias("member_sha"), F.lit(True).alias("packed"))
    reason = F.expr(
        "case when entries > 1 then 'LISTED_TWICE' when packed is null then 'NOT_IN_PACKAGE' when listed is null then 'NOT_IN_INDEX'"
        " when not (index_length <=> member_length) then 'LENGTH_MISMATCH' when not (index_sha <=> member_sha) then 'DIGEST_MISMATCH' end"
    )
    return left.join(right, ["package_id", "path"], "full").withColumn("reason", reason).where("reason is not null").select(
        "package_id", "path", "reason")


def misplaced_artifacts(members: DataFrame, prefix: str = "artifacts/") -> DataFrame:
    """Artifact members that are not stored under their own digest."""
    stem = F.regexp_replace(F.expr(f"substring(path, {len(prefix) + 1})"), r"\.[^.]*$", "")
    return members.where(F.col("path").startswith(prefix)).where(stem != F.col("sha256"))


def unresolved_registry_refs(references: DataFrame, snapshots: DataFrame, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Registry references ``(package_id, registry, sha256)`` without a bound snapshot of that digest.

    With ``digest`` both hold a ``content`` shorter than its digest instead; it is met by content, and only what is unresolved is digested.
    """
    key = "sha256" if digest is None else "content"
    found = references.join(snapshots.select("package_id", key).distinct(), ["package_id", key], "left_anti")
    return found if digest is None else found.withColumn("sha256", digest(F.col("content"))).drop("content")


def expected_bundle_names() -> list[str]:
    """The 80 member names of an acceptance bundle, from a rule: six reports and two frame series."""
    frames = [f"{arm}-frame-{i:03d}.png" for arm in ("candidate", "comparator") for i in range(fixed.FRAME_COUNT)]
    return [*fixed.BUNDLE_REPORTS, *frames]


def verify_bundles(bundles: DataFrame, entries: DataFrame, max_total_bytes: int) -> DataFrame:
    """Per bundle: missing and extra names, digest and length mismatches, aggregate budget and the verdict.

    ``entries``: (bundle_id, name, byte_length, sha256, actual_length, actual_sha256). The expected names are a fixed
    80-element array, so the count of expected names present is an ``array_contains`` inside one aggregate per bundle.
    """
    names = F.array(*[F.lit(n) for n in expected_bundle_names()])
    expected = F.array_contains(names, F.col("name"))
    unique = entries.groupBy("bundle_id", "name").agg(
        F.count("*").alias("copies"), F.max("actual_length").alias("actual_length"),
        F.max(F.expr("cast(not (byte_length <=> actual_length) as int)")).alias("bad_length"),
        F.max(F.expr("cast(not (sha256 <=> actual_sha256) as int)")).alias("bad_digest"))
    facts = unique.withColumn("expected", expected).groupBy("bundle_id").agg(
        F.count_if("expected").alias("present"), F.count_if(~F.col("expected")).alias("extra"),
        F.count_if(F.col("copies") > 1).alias("duplicated"), F.sum("bad_length").alias("bad_length"),
        F.sum("bad_digest").alias("bad_digest"), F.sum("actual_length").alias("total_bytes"))
    joined = bundles.select("bundle_id").join(facts, "bundle_id", "left").na.fill(0)
    out = joined.withColumn("missing", F.lit(len(expected_bundle_names())) - F.col("present"))
    verdict = F.expr(f"missing = 0 and extra = 0 and duplicated = 0 and bad_length = 0 and bad_digest = 0 and total_bytes <= {max_total_bytes}")
    return out.withColumn("verified", verdict).drop("present")


def frames_disagreeing(report_frames: DataFrame, expected_frames: DataFrame) -> DataFrame:
    """Frames of a report that differ from the seeded sequence in id or index, in either direction."""
    l = report_frames.select("run_id", "idx", F.col("frame_id").alias("reported"))
    r = expected_frames.select("run_id", "idx", F.col("frame_id").alias("expected"))
    return l.join(r, ["run_id", "idx"], "full").where("not (reported <=> expected)")


def reconcile_inventory(declared: DataFrame, found: DataFrame, max_depth: int, max_bytes: int) -> DataFrame:
    """Declared files against found files, in both directions, plus depth and size bounds."""
    l = declared.groupBy("run_id", "uri").agg(F.count("*").alias("declared_n"), F.min("byte_length").alias("declared_length"))
    r = found.select("run_id", "uri", F.col("byte_length").alias("found_length"))
    reason = F.expr(
        f"case when found_length is null then 'MISSING' when declared_length is null then 'UNDECLARED' when declared_n > 1 then 'DECLARED_TWICE'"
        f" when declared_length <> found_length then 'LENGTH_MISMATCH' when size(split(uri, '/')) > {max_depth} then 'TOO_DEEP'"
        f" when found_length > {max_bytes} then 'TOO_LARGE' end"
    )
    return l.join(r, ["run_id", "uri"], "full").withColumn("reason", reason).where("reason is not null").select("run_id", "uri", "reason")


def manifest_order(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Per manifest: entries out of strictly increasing path order and whether a ``.psd`` member exists."""
    previous = hotkeys.lag(rows, ["manifest_id"], F.expr(f"position div {block}"), ["position"], {"previous_path": "path"})
    return previous.groupBy("manifest_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.expr("previous_path is not null and path <= previous_path")).alias("out_of_order"),
        F.max(F.col("path").endswith(".psd")).alias("has_psd"))


def dedupe_content(artifacts: DataFrame) -> DataFrame:
    """One row per digest: most specific role, strictest sensitivity, and whether two media types clash.

    Role and sensitivity are ranked as integers, so the whole reduction is a hash aggregate with map-side combine; a
    digest that a third of all rows share costs one small partial row per task.
    """
    def rank(column: str, names: tuple[str, ...]):
        return F.min(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)))

    def name(rank_column: str, names: tuple[str, ...]):
        return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(rank_column).cast("int"))

    merged = artifacts.groupBy("sha256").agg(
        F.count("*").alias("copies"), rank("role", fixed.ROLE_PRIORITY).alias("role_rank"),
        rank("sensitivity", fixed.SENSITIVITY_PRIORITY).alias("sensitivity_rank"),
        F.min("media_type").alias("media_type"), F.max("media_type").alias("other_media_type"), F.max("byte_length").alias("byte_length"))
    extension = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.MEDIA_EXTENSIONS.items() for x in kv]), F.col("media_type"))
    return merged.select(
        F.concat(F.lit("sha256:"), "sha256").alias("id"), F.concat(F.lit("artifacts/"), "sha256", F.lit("."), extension).alias("uri"),
        "sha256", "byte_length", "media_type", name("role_rank", fixed.ROLE_PRIORITY).alias("role"),
        name("sensitivity_rank", fixed.SENSITIVITY_PRIORITY).alias("sensitivity"), "copies",
        (F.col("media_type") != F.col("other_media_type")).alias("media_type_clash"))


def local_link_errors(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links ``(doc_id, site, base, target)`` that leave their site's root or whose resolved path does not exist.

    ``base`` is the directory of the linking document ('' for the root). Relative segments are folded per row; distinct
    resolved targets are looked up once, then attached to every link that uses them.
    """
    local = links.withColumn("target", F.trim(F.substring_index("target", "#", 1))).where(
        "target <> '' and not target rlike '^(http://|https://|mailto:)'")
    joined = F.expr("if(startswith(target, '/'), target, concat(base, '/', target))")
    folded = F.expr(
        "aggregate(filter(split(joined, '/'), s -> s not in ('', '.')),"
        " named_struct('stack', cast(array() as array<string>), 'escaped', false),"
        " (acc, s) -> case when s = '..' and size(acc.stack) = 0 then named_struct('stack', acc.stack, 'escaped', true)"
        " when s = '..' then named_struct('stack', slice(acc.stack, 1, size(acc.stack) - 1), 'escaped', acc.escaped)"
        " else named_struct('stack', array_append(acc.stack, s), 'escaped', acc.escaped) end)"
    )
    resolved = local.withColumn("joined", joined).withColumn("f", folded).select(
        "doc_id", "site", "target", F.array_join("f.stack", "/").alias("path"), F.col("f.escaped").alias("escaped"))
    known = targets.select("site", "path").distinct().withColumn("exists", F.lit(True))
    reason = F.expr("case when escaped then 'ESCAPES_ROOT' when exists is null then 'BROKEN' end")
    return resolved.join(known, ["site", "path"], "left").withColumn("reason", reason).where("reason is not null").select(
        "doc_id", "site", "target", "reason")


def extract_links(docs: DataFrame, text: str, pattern: str, group: int = 1) -> DataFrame:
    return docs.withColumn("target", F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), group)))


def missing_index_links(required: DataFrame, index_links: DataFrame) -> DataFrame:
    """Required targets that an index document does not link to."""
    return required.join(index_links.select("site", "target").distinct(), ["site", "target"], "left_anti")


def phrase_hits(docs: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Prohibited phrases found in each document's whole text; the list is a literal array, so nothing is joined."""
    listed = F.array(*[F.lit(p.lower()) for p in phrases])
    lowered = F.lower(F.col(text))
    hits = F.filter(listed, lambda p: F.contains(lowered, p))
    return docs.withColumn("phrase", F.explode(hits))


def missing_prefixes(docs: DataFrame, text: str, pattern: str, required: list[str]) -> DataFrame:
    """Required id prefixes that a document's headings never use."""
    present = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))
    return docs.withColumn("prefix", F.explode(F.array_except(F.array(*[F.lit(p) for p in required]), present)))
