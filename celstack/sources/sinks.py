"""Sinks: content-addressed artifacts that are never overwritten, and reports with deterministic text."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators import hotkeys
from ..session import cut

SEGMENT_BYTES = 128 << 20
NAME_RULE = "^[a-z0-9][a-z0-9._-]{0,127}$"


def admit_artifacts(files: DataFrame, stored: DataFrame, max_files: int, max_bytes: int, block: int = 1024) -> DataFrame:
    """Decide about every output ``(attempt_id, position, name, sha256, byte_length)`` in write order.

    The first broken rule stops nothing but its own row, except the budgets, which count every earlier valid file of the
    attempt. Content that is stored already is linked instead of written.
    """
    copies = files.groupBy("attempt_id", "name").agg(F.min("position").alias("first_position"))
    known = stored.select("sha256").distinct().withColumn("is_stored", F.lit(True))
    marked = files.join(copies, ["attempt_id", "name"]).withColumn(
        "name_problem", F.when(~F.col("name").rlike(NAME_RULE), "NAME_NOT_PERMITTED").when(F.col("position") != F.col("first_position"), "NAME_DUPLICATED"))
    counted = F.col("name_problem").isNull()
    bucket = F.expr(f"position div {block}")
    ranked = hotkeys.running(marked, ["attempt_id"], bucket, ["position"], "nth", F.when(counted, F.lit(1).cast("bigint")), "sum")
    summed = hotkeys.running(ranked, ["attempt_id"], bucket, ["position"], "bytes", F.when(counted, F.col("byte_length").cast("bigint")), "sum")
    decision = F.expr(
        f"case when name_problem is not null then name_problem when nth > {max_files} then 'FILE_LIMIT' when bytes > {max_bytes} then 'BYTE_LIMIT'"
        " when is_stored then 'linked' else 'write' end")
    return summed.join(known, "sha256", "left").withColumn("decision", decision).select("attempt_id", "position", "name", "sha256", "decision")


@dataclass
class Segments(WriterCommitMessage):
    """What one task wrote: (file name, rows, content bytes) of each of its segments."""

    files: list[tuple[str, int, int]]


class ArtifactStore(DataSource):
    """``format("artifact_store")``: append-only segments of (sha256, content), visible once their commit file exists.

    Tasks write segments under names that never occur twice and tell the driver; the driver writes one commit file that lists them all.
    A failed or repeated task leaves segments that no commit lists, and nothing that was written is ever touched again.
    """

    @classmethod
    def name(cls) -> str:
        return "artifact_store"

    def schema(self) -> str:
        return "sha256 string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("an artifact store is only appended to")
        return ArtifactWriter(self.options["path"], int(self.options.get("segmentbytes", SEGMENT_BYTES)))


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, path: str, segment_bytes: int) -> None:
        self.path, self.segment_bytes = path, segment_bytes

    def _folder(self, name: str):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        files.create_dir(f"{root}/{name}", recursive=True)
        return files, f"{root}/{name}"

    def write(self, iterator: Iterator) -> Segments:
        """One segment at a time, closed when it holds ``segment_bytes``; batches are bounded, so the task's memory is too."""
        import pyarrow.parquet as pq

        files, folder = self._folder("segments")
        written, out, writer, rows, size = [], None, None, 0, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                name, rows, size = f"{uuid.uuid4().hex}.parquet", 0, 0
                out = files.open_output_stream(f"{folder}/{name}")
                writer = pq.ParquetWriter(out, batch.schema)
            writer.write_batch(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if size >= self.segment_bytes:
                writer.close()
                out.close()
                written.append((name, rows, size))
                writer = None
        if writer is not None:
            writer.close()
            out.close()
            written.append((name, rows, size))
        return Segments(written)

    def commit(self, messages: list) -> None:
        files, folder = self._folder("commits")
        listed = sorted(f for m in messages if m is not None for f in m.files)
        name = f"{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{folder}/.{name}") as out:
            out.write(json.dumps({"segments": [{"name": n, "rows": r, "bytes": b} for n, r, b in listed]}).encode())
        files.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        files, folder = self._folder("segments")
        for message in messages:
            for name, _, _ in message.files if message is not None else ():
                files.delete_file(f"{folder}/{name}")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, content) of all committed segments."""
    listed = spark.read.schema("segments array<struct<name: string, rows: bigint, bytes: bigint>>").json(f"{path}/commits")
    segments = listed.select(F.explode("segments.name").alias("segment")).distinct()
    rows = spark.read.schema("sha256 string, content binary").parquet(f"{path}/segments")
    return rows.withColumn("segment", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(segments, "segment", "left_semi").select("sha256", "content")


def write_artifacts(decided: DataFrame, payloads: DataFrame, path: str, most_broadcast: int = 1 << 18) -> None:
    """Append the contents decided as ``write`` to the store at ``path``, each digest once.

    ``payloads`` is (payload_id, sha256, content). Of equal contents the one with the smallest id is written, which is settled on ids and
    digests alone. Payloads are filtered where they are read: up to ``most_broadcast`` chosen ids are broadcast (16 MB); only beyond that
    are contents shuffled, by payload id. There are as many writing tasks as partitions of the payloads, which follow their size.
    """
    payloads.sparkSession.dataSource.register(ArtifactStore)
    wanted = decided.where("decision = 'write'").select("sha256").distinct()
    chosen = payloads.select("sha256", "payload_id").join(wanted, "sha256", "left_semi").groupBy("sha256").agg(F.min("payload_id").alias("payload_id")).select("payload_id")
    chosen = cut(chosen)
    kept = payloads.join(F.broadcast(chosen) if chosen.count() <= most_broadcast else chosen, "payload_id", "left_semi")
    kept.select("sha256", "content").write.format("artifact_store").mode("append").save(path)


def sorted_json(df: DataFrame) -> Column:
    """JSON text of a row with keys in name order at every struct level."""
    def ordered(prefix: str, schema: T.StructType) -> Column:
        fields = []
        for field in sorted(schema.fields, key=lambda f: f.name):
            path = f"{prefix}`{field.name}`"
            value = ordered(path + ".", field.dataType) if isinstance(field.dataType, T.StructType) else F.col(path)
            fields.append(value.alias(field.name))
        return F.struct(*fields)

    return F.to_json(ordered("", df.schema))


def write_reports(df: DataFrame, keys: list[str], path: str) -> None:
    """Text lines in a total order of the keys; equal input gives equal bytes for a fixed number of files."""
    lines = df.select(*keys, sorted_json(df).alias("line"))
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys, "line").select("line").write.mode("errorifexists").text(path)
