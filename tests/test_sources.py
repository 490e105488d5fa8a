"""Scans and sinks over files written by the tests."""

from __future__ import annotations

import json
import struct
import tempfile
import zlib
from pathlib import Path

import pytest

from celstack.functions import fixed
from celstack.operators import graph
from celstack.sources import documents, files, registries, sinks


def png(w: int, h: int, at, alpha: bool) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + b"".join(bytes(at(x, y)[: 4 if alpha else 3]) for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def grey_png(w, h):
    """One 8-bit channel; every raster row counts up from 90."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(90 + x for x in range(w)) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def colour(x, y):
    return (x * 7 % 256, y * 5 % 256, (x + y) * 3 % 256, (x * y * 11) % 256)


def test_scan_rasters_and_uploads(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-test-"))
    (folder / "a.png").write_bytes(png(5, 4, colour, True))
    (folder / "b.png").write_bytes(png(3, 2, colour, False))
    (folder / "c.png").write_bytes(b"not an image")
    (folder / "d.png").write_bytes(b"")
    (folder / "e.png").write_bytes(grey_png(3, 3))
    rasters = files.scan_rasters(spark, str(folder))
    scanned = files.raster_pixels(rasters)
    facts = {Path(r["image_id"]).name: r for r in files.raster_facts(rasters, scanned, 1, 100, 1000).collect() if r["width"]}
    broken = {Path(r["image_id"]).name: (r["reason_code"], r["width"], r["data"]) for r in rasters.where("reason_code is not null").collect()}
    assert broken.pop("c.png") == ("INPUT_CORRUPT", None, None) and set(broken) <= {"d.png"}
    assert set(facts) == {"a.png", "b.png", "e.png"} and facts["a.png"]["had_alpha"] and not facts["b.png"]["had_alpha"]
    assert files.raster_facts(rasters, scanned).where("reason_code = 'INPUT_UNSUPPORTED'").count() == 3
    for r in scanned.collect():
        name, want = Path(r["image_id"]).name, colour(r["x"], r["y"])
        if name == "e.png":
            want = (90 + r["x"],) * 3
        got = (r["r"], r["g"], r["b"], r["a"])
        assert got == (want if name == "a.png" else (*want[:3], 255))
    paths = [r["path"] for r in spark.read.format("binaryFile").load(str(folder)).select("path").collect()]
    paths.append(paths[0].rsplit("/", 1)[0] + "/d.png")
    declared = spark.createDataFrame([(p, "image/jpeg" if p.endswith("b.png") else "image/png") for p in paths], "path string, declared_type string")
    verdict = {Path(r["path"]).name: r["reason_code"] for r in files.scan_uploads(spark, str(folder), declared).collect()}
    assert verdict == {"a.png": None, "b.png": "INPUT_UNSUPPORTED", "c.png": "INPUT_UNSUPPORTED", "d.png": "INPUT_UNSUPPORTED", "e.png": None}


def test_versioned_documents(spark):
    """Files of two versions, each by its own layout; what does not fit gives a reason and no rows."""
    folder = Path(tempfile.mkdtemp(prefix="spark-test-"))
    empty = {name: [] for name in documents.PROJECT_PARTS["0.2.0"]}
    new = {"format": "p", "format_version": "0.2.0", "project_id": "project.a", "revision_id": "rev.1"} | empty | {
        "layers": [{"id": "layer.a", "draw_order": 3, "bounds": {"x": 1.5, "y": 2, "width": 3, "height": 4, "unit": "pixel", "space": "source"}}, {"id": "layer.b", "draw_order": 4}],
        "confidence_facts": [{"id": "f1", "target_id": "layer.a", "score": "unavailable"}, {"id": "f2", "target_id": "layer.b", "score": 0.25}]}
    old = {"format": "p", "format_version": "0.1.0", "project_id": "project.old"} | {name: [] for name in documents.PROJECT_PARTS["0.1.0"] if name != "user_overrides"} | {
        "layers": [{"id": "layer.x", "semantic": "face", "confidence": 0.5}], "occlusion_edges": [{"behind_layer_id": "layer.x", "in_front_layer_id": "layer.y"}]}
    cases = {"a": json.dumps(new), "b": json.dumps(new)[:50], "c": json.dumps(old), "d": json.dumps(new | {"format_version": "7.0.0"}), "e": json.dumps(new | {"layers": {"id": "layer.a"}}),
             "f": json.dumps(new | {"meshes": [None]}), "g": json.dumps(new | {"format": "q"}), "h": "[]", "i": json.dumps({k: v for k, v in new.items() if k != "project_id"})}
    for name, text in cases.items():
        (folder / f"{name}.json").write_text(text)
    read = documents.ingest_projects(documents.read_texts(spark, str(folder)), "value", "p")
    assert {Path(r["path"]).stem: r["reason_code"] for r in documents.rejected(read, ["path"]).collect()} == {
        "b": "DOCUMENT_UNREADABLE", "d": "VERSION_UNKNOWN", "e": "PART_MALFORMED:layers", "f": "PART_MALFORMED:meshes", "g": "FORMAT_UNKNOWN", "h": "FORMAT_UNKNOWN", "i": "HEAD_MALFORMED"}
    tables = documents.project_tables(read)
    layers = {r["id"]: r for r in tables["layers"].collect()}
    assert {k: (r["draw_order"], r["position"]) for k, r in layers.items()} == {"layer.a": (3, 0), "layer.b": (4, 1)} and layers["layer.a"]["bounds"]["x"] == 1.5
    assert {r["id"]: (r["score"], r["score_available"]) for r in tables["confidence_facts"].collect()} == {"f1": (None, False), "f2": (0.25, True)}
    legacy = documents.project_tables(read, "0.1.0")
    assert [(r["project_id"], r["semantic"]) for r in legacy["layers"].collect()] == [("project.old", "face")] and legacy["occlusion_edges"].count() == 1
    assert len(tables) == 10 and documents.heads(read, "0.2.0").count() == 1


def test_versioned_manifests(spark):
    stage = {"id": "s", "attempt_id": "t", "status": "succeeded", "limits": {"gpu_allowed": False}, "outputs": [{"role": "result", "sha256": "0", "byte_length": 1}]}
    runs = [{"format": "m", "format_version": "0.2.0", "run_id": "run.x", "stages": [stage]}, {"format": "m", "format_version": "7.0.0", "run_id": "run.y", "stages": [stage]},
            {"format": "m", "format_version": "0.1.0", "run_id": "run.z", "stages": [{"id": "s", "peak_ram_bytes": 5}]}]
    read = documents.ingest_manifests(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(runs)], "n int, text string"), "text", "m")
    assert [r["run_id"] for r in documents.stage_outputs(documents.part(read, "stages", "0.2.0")).collect()] == ["run.x"]
    assert [r["peak_ram_bytes"] for r in documents.part(read, "stages", "0.1.0").collect()] == [5]
    assert [tuple(r) for r in documents.rejected(read, ["n"]).collect()] == [(1, "7.0.0", "VERSION_UNKNOWN")]


def test_discovered_files(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-test-"))
    for name in "pr":
        (folder / name).mkdir()
        (folder / name / "x.json").write_text("{}")
    assert {r["run_id"] for r in files.discovered_files(spark, str(folder), "*.json").collect()} == {"p", "r"}


def test_sinks(spark):
    folder = tempfile.mkdtemp(prefix="spark-test-")
    data = [("a.png", b"one"), ("b.png", b"two"), ("a.png", b"three"), ("Bad", b"x"), ("c.png", b"one"), ("d.png", b"four"), ("e.png", b"five")]
    rows = [(1, i, n, f"sha-{c.decode()}", len(c)) for i, (n, c) in enumerate(data)]
    df = spark.createDataFrame(rows, "attempt_id bigint, position bigint, name string, sha256 string, byte_length bigint")
    stored = spark.createDataFrame([("sha-two",)], "sha256 string")
    decided = sinks.admit_artifacts(df, stored, max_files=5, max_bytes=13, block=2)
    assert [r["decision"] for r in decided.orderBy("position").collect()] == ["write", "linked", "NAME_DUPLICATED", "NAME_NOT_PERMITTED", "write", "write", "BYTE_LIMIT"]
    payloads = spark.createDataFrame([(i, f"sha-{c.decode()}", bytearray(c)) for i, (_, c) in enumerate(data)], "payload_id int, sha256 string, content binary").repartition(3)
    sinks.write_artifacts(decided, payloads, f"{folder}/store")
    read = lambda: sorted((r["sha256"], bytes(r["content"])) for r in sinks.read_artifacts(spark, f"{folder}/store").collect())
    assert read() == [("sha-four", b"four"), ("sha-one", b"one")]
    first = {p.name: p.read_bytes() for p in Path(f"{folder}/store/segments").iterdir()}
    (Path(folder) / "store/segments/stray.parquet").write_bytes(next(v for k, v in first.items() if k.endswith(".parquet")))  # of a task that failed
    sinks.write_artifacts(spark.createDataFrame([("sha-two", "write")], "sha256 string, decision string"), payloads, f"{folder}/store", most_broadcast=0)
    assert read() == [("sha-four", b"four"), ("sha-one", b"one"), ("sha-two", b"two")]
    assert all(Path(f"{folder}/store/segments/{name}").read_bytes() == data for name, data in first.items())
    with pytest.raises(Exception, match="only appended"):
        payloads.select("sha256", "content").write.format("artifact_store").mode("overwrite").save(f"{folder}/store")
    sinks.write_artifacts(decided.where("false"), payloads, f"{folder}/store")
    assert len(read()) == 3 and len(list(Path(f"{folder}/store/commits").glob("*.json"))) == 3
    report = spark.createDataFrame([(i, i * i) for i in (3, 1, 2)], "z int, b int")
    sinks.write_reports(report, ["z"], f"{folder}/report")
    assert sorted(r["value"] for r in spark.read.text(f"{folder}/report").collect()) == ['{"b":1,"z":1}', '{"b":4,"z":2}', '{"b":9,"z":3}']


def test_registries(spark):
    slots, parameters = registries.slots(spark, "ns."), registries.parameters(spark)
    assert slots.count() == len(fixed.SLOTS) == 16 and parameters.count() == 10
    assert registries.slot_domain_errors(slots).count() == 0 and registries.parameter_domain_errors(parameters).count() == 0
    tree = slots.selectExpr("slot_id as node", "parent")
    assert graph.parent_chain(tree).count() == 0
    broken = tree.unionByName(spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "gone")], "node string, parent string"))
    assert {(r["node"], r["problem"]) for r in graph.parent_chain(broken).collect()} == {("x", "CYCLE"), ("y", "CYCLE"), ("z", "PARENT_MISSING")}
    folder = Path(tempfile.mkdtemp(prefix="spark-test-"))
    (folder / "o.json").write_text(json.dumps({"registry": "r", "version": "1", "slots": [{"id": "face", "parent": None, "cardinality": "exactly_one", "applicability": "required"}, {"id": "X", "side": "up"}]}, indent=1))
    assert {r["reason"] for r in registries.slot_domain_errors(registries.read_ontology(spark, str(folder / "o.json"))).collect()} == {"BAD_ID"}


def test_reason_code_registries(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-test-"))
    cause = {"id": "INPUT_BAD", "severity": "blocking", "outcome": "BLOCK", "retryable": False}
    good = {"registry": "r", "version": "1.0.0", "operational_causes": [cause], "quality_findings": [{"id": "SOFT", "severity": "info", "category": "INPUT"}]}
    (folder / "a.json").write_text(json.dumps(good))
    assert registries.reason_code_errors(registries.read_reason_codes(spark, str(folder))).collect() == []
    read = registries.read_reason_codes(spark, str(folder)).orderBy("axis").collect()
    assert [(r["axis"], r["id"], r["retryable"], r["category"]) for r in read] == [("operational_causes", "INPUT_BAD", False, None), ("quality_findings", "SOFT", None, "INPUT")]
    (folder / "b.json").write_text(json.dumps(good | {"version": "2.0.0", "quality_findings": [{"id": "INPUT_BAD", "severity": "info"}, {"severity": "info"}, {"id": "X", "severity": "fatal"}]}))
    (folder / "c.json").write_text(json.dumps({"registry": "q", "version": "1.0.0", "operational_causes": [cause]}))
    found = registries.reason_code_errors(registries.read_reason_codes(spark, str(folder)))
    assert {(r["registry"], r["version"], r["axis"], r["position"], r["reason"]) for r in found.collect()} == {
        ("r", "2.0.0", "operational_causes", 0, "ID_DUPLICATED"), ("r", "2.0.0", "quality_findings", 0, "ID_DUPLICATED"), ("r", "2.0.0", "quality_findings", 1, "ENTRY_MALFORMED"),
        ("r", "2.0.0", "quality_findings", 2, "SEVERITY_UNSUPPORTED"), ("q", "1.0.0", "quality_findings", None, "AXIS_MISSING")}


def test_documents_are_made_in_more_than_one_task(spark, monkeypatch):
    from celstack.plans import documents as P

    monkeypatch.setattr(P.V, "ingest_projects", lambda texts, column, name: texts)
    monkeypatch.setattr(P.V, "ingest_manifests", lambda texts, column, name: texts)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert P._project_documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == n
    assert P._manifests(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == n


def test_only_what_is_read_is_typed(spark, monkeypatch):
    """A query types and writes its own part only."""
    from celstack.plans import load

    registry, written = load(), []
    monkeypatch.setattr(documents, "cut", lambda df: written.append(df) or df)
    for name, wanted in (("rejected_documents", set()), ("project_heads", set()), ("project_meshes", {"meshes_0_1_0", "meshes_0_2_0"})):
        registry[name].run(spark, "/root/testdata/sf0.001")
        assert {c for c in written[-1].columns if not c.startswith("head_")} == {"o_orderkey", "format_version", "reason_code"} | wanted


def test_values_that_do_not_fit_are_found_in_parts_that_are_not_read(spark):
    sound = {"format": "p", "format_version": "0.2.0", "project_id": "a", "revision_id": "r"} | {name: [] for name in documents.PROJECT_PARTS["0.2.0"]}
    cases = {
        "text as number": ({"meshes": [{"id": "m", "vertex_count": "many"}]}, "meshes"), "number in text": ({"meshes": [{"id": "m", "vertex_count": "12"}]}, None),
        "too large": ({"meshes": [{"id": "m"}, {"id": "n", "vertex_count": 3_000_000_000}]}, "meshes"), "null": ({"meshes": [{"id": "m", "vertex_count": None}]}, None),
        "no id": ({"meshes": [{"vertex_count": 1}]}, "meshes"), "null id": ({"artifacts": [{"id": None}]}, "artifacts"), "number as text": ({"artifacts": [{"id": 7, "uri": {"x": [1]}}]}, None),
        "no list": ({"provenance": [{"id": "p", "input_sha256": "abc"}]}, "provenance"), "any list": ({"provenance": [{"id": "p", "input_sha256": [1, None, {}]}]}, None),
        "no object": ({"layers": [{"id": "l", "bounds": [1]}]}, "layers"), "any object": ({"layers": [{"id": "l", "bounds": {"x": "left"}}]}, None), "no flag": ({"layers": [{"id": "l", "visible": "maybe"}]}, "layers"),
        "no element": ({"bindings": ["b"]}, "bindings"), "no array": ({"bindings": None}, "bindings")}
    texts = spark.createDataFrame([(k, json.dumps(sound | change)) for k, (change, _) in cases.items()], "k string, text string")
    for keep in (None, ("reason",), ("meshes",)):
        read = documents.ingest_projects(texts, "text", "p", keep)
        assert {r["k"]: r["reason_code"] for r in documents.rejected(read, ["k"]).collect()} == {k: f"PART_MALFORMED:{part}" for k, (_, part) in cases.items() if part}
    assert documents.part(documents.ingest_projects(texts, "text", "p", ("meshes",)), "meshes", "0.2.0").count() == 2
