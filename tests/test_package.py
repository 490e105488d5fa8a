"""Bundle and artifact checks must fail closed on missing bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from celstack.operators import integrity, package

ENTRY = "bundle_id bigint, name string, byte_length bigint, sha256 string, actual_length bigint, actual_sha256 string"


def test_a_bundle_member_without_bytes_fails(spark):
    names = package.expected_bundle_names()
    whole = [(1, n, 5, "d", 5, "d") for n in names]
    absent = [(2, n, 5, "d", *((5, "d") if k else (None, None))) for k, n in enumerate(names)]
    undeclared = [(3, n, *((5, "d") if k else (None, None)), 5, "d") for k, n in enumerate(names)]
    bundles = spark.createDataFrame([(1,), (2,), (3,), (4,)], "bundle_id bigint")
    got = {r["bundle_id"]: r for r in package.verify_bundles(bundles, spark.createDataFrame(whole + absent + undeclared, ENTRY), 10_000).collect()}
    assert {k: r["verified"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}
    assert (got[2]["bad_length"], got[2]["bad_digest"]) == (1, 1) and got[4]["missing"] == len(names)


def test_artifacts_without_a_declared_digest_or_length(spark):
    digest = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    rows = [("sha256:" + digest, digest, 5, 1), ("sha256:" + digest, None, 5, 1), ("sha256:" + digest, digest, None, 1), (None, digest, 5, 1), ("x", digest, 5, 2)]
    artifacts = spark.createDataFrame(rows, "id string, sha256 string, byte_length bigint, payload_key bigint")
    payloads = spark.createDataFrame([(1, b"hello")], "payload_key bigint, content binary")
    assert sorted(r["reason"] for r in integrity.artifact_errors(artifacts, payloads).collect()) == ["BYTES_MISSING", "DIGEST_MISMATCH", "LENGTH_MISMATCH", "NOT_CONTENT_ADDRESS"]


def test_index_entries_without_a_digest(spark):
    index = spark.createDataFrame([(1, "a", 3, None), (1, "b", 3, "d"), (1, "c", None, "d")], "package_id bigint, path string, byte_length bigint, sha256 string")
    members = spark.createDataFrame([(1, "a", 3, "d"), (1, "b", 3, "d"), (1, "c", 3, "d"), (1, "e", 1, None)], "package_id bigint, path string, byte_length bigint, sha256 string")
    got = {r["path"]: r["reason"] for r in package.index_differences(index, members, "index.json").collect()}
    assert got == {"a": "DIGEST_MISMATCH", "c": "LENGTH_MISMATCH", "e": "NOT_IN_INDEX"}


def test_registry_refs_are_digested_after_they_met(spark):
    refs = spark.createDataFrame([(1, "parameters", 3), (1, "reason-codes", 4), (2, "parameters", 3)], "package_id bigint, registry string, content bigint")
    bound = spark.createDataFrame([(1, 3), (1, 3), (2, 4)], "package_id bigint, content bigint")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    digested = lambda df: df.withColumn("sha256", sha(F.col("content"))).drop("content")
    rows = lambda df: sorted(tuple(r[c] for c in ("package_id", "registry", "sha256")) for r in df.collect())
    found = rows(package.unresolved_registry_refs(refs, bound, sha))
    assert found == rows(package.unresolved_registry_refs(digested(refs), digested(bound))) and len(found) == 2


def test_bound_digests_are_taken_after_they_met(spark):
    packages = spark.createDataFrame([(1, 1, 10), (2, None, 20)], "package_id bigint, payload bigint, revision_id bigint")
    records = spark.createDataFrame([(1, "report", 1, 10), (1, "release", 2, 10), (1, "run_manifest", 1, 11), (1, "report", None, 10), (2, "report", 2, 20), (3, "report", 3, 30)],
                                    "package_id bigint, kind string, payload bigint, revision_id bigint")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    digested = lambda df: df.withColumn("payload_sha256", sha(F.col("payload"))).drop("payload")
    rows = lambda df: sorted(tuple(r[c] for c in ("package_id", "kind", "reason")) for r in df.collect())
    found = rows(integrity.digest_bindings(packages, records, sha))
    assert found == rows(integrity.digest_bindings(digested(packages), digested(records)))
    assert [r[2] for r in found] == ["PAYLOAD_DIGEST_MISMATCH", "PAYLOAD_DIGEST_MISMATCH", "REVISION_MISMATCH", "NO_PACKAGE", "NO_PACKAGE"]
