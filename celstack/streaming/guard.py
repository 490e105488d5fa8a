"""Late-result guard with keyed expiry, and a sink that commits each batch once.

State per (run, stage): one value (owner, published) and two maps by page of sequence numbers: rows of the running micro-batch beyond
the ``held`` that are sorted in memory, and the results judged so far, which expire. Every access to state is a round trip, so a run of few
rows makes few. A run that holds a third of all events is worked off page by page; no frame or list holds its history, and what is kept
of it ends ``expire_ms`` after its last change.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GUARD_SCHEMA = "run_id bigint, stage int, seq bigint, attempt bigint, owner bigint, verdict string"
PAGE, HELD, EXPIRE_MS = 65_536, 65_536, 7 * 86_400_000


class LateResultGuard(StatefulProcessor):
    def __init__(self, page: int, expire_ms: int, held: int) -> None:
        self.page, self.expire_ms, self.held = page, expire_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stage = handle.getValueState("stage", "owner bigint, published boolean")
        self.judged = handle.getMapState("judged", "page bigint", "seqs array<bigint>", ttlDurationMs=self.expire_ms)
        self.waiting = handle.getMapState("waiting", "page bigint", "rows array<struct<seq: bigint, is_open: boolean, attempt: bigint>>")

    def _put_off(self, rows: list[tuple[int, bool, int]]) -> None:
        pages: dict[int, list] = {}
        for row in rows:
            pages.setdefault(row[0] // self.page, []).append(row)
        for page, part in pages.items():
            if self.waiting.containsKey((page,)):
                part = part + [tuple(x) for x in self.waiting.getValue((page,))[0]]
            self.waiting.updateValue((page,), (part,))

    def _pages(self, held: list[tuple[int, bool, int]], put_off: bool) -> Iterator[tuple[int, list[tuple[int, bool, int]]]]:
        """Rows of the batch in order, by page."""
        if not put_off:
            for page, part in groupby(sorted(held), lambda row: row[0] // self.page):
                yield page, list(part)
            return
        self._put_off(held)
        for page in sorted(p[0] for p in self.waiting.keys()):
            yield page, sorted(tuple(x) for x in self.waiting.getValue((page,))[0])
            self.waiting.removeKey((page,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = lambda out: pd.DataFrame(out, columns=["run_id", "stage", "seq", "attempt", "owner", "verdict"]).astype({"owner": "Int64"})
        held, put_off, out = [], False, []
        for chunk in rows:
            held += [(int(s), k == "open", int(a)) for s, k, a in zip(chunk["seq"], chunk["kind"], chunk["attempt"], strict=True)]
            if len(held) > self.held:
                self._put_off(held)
                held, put_off = [], True
        seen = self.stage.exists()  # nothing was judged before the first rows
        owner, published = self.stage.get() if seen else (None, False)
        for page, part in self._pages(held, put_off):
            known = list(self.judged.getValue((page,))[0]) if seen and self.judged.containsKey((page,)) else []
            before = set(known)
            for seq, is_open, attempt in part:
                if is_open:
                    owner = attempt
                    continue
                if seq in before:
                    verdict = "duplicate"
                elif owner is None or attempt != owner:
                    verdict = "lost_ownership"
                else:
                    verdict, published = ("already_published" if published else "accepted"), True
                before.add(seq)
                out.append((*key, seq, attempt, owner, verdict))
            if any(not is_open for _, is_open, _ in part):
                self.judged.updateValue((page,), (sorted(before),))
            if len(out) >= self.held:
                yield frame(out)
                out = []
        if out:
            yield frame(out)
        self.stage.update((owner, published))

    def close(self) -> None:
        pass


def late_result_guard(stream: DataFrame, page: int = PAGE, expire_ms: int = EXPIRE_MS, held: int = HELD) -> DataFrame:
    """Verdict on every published result of a ledger stream ``(run_id, stage, seq, kind, attempt)``.

    Within a micro-batch a stage's rows are judged by ``seq``. The first result of the owning attempt is ``accepted``, later ones are
    ``already_published``, those of other attempts ``lost_ownership``, and a result delivered again is a ``duplicate``: every result gets a
    row, however late. ``expire_ms`` after a page's last result its numbers are forgotten; a repeat is then refused as published or lost,
    never accepted, since owner and publication do not expire. Needs the RocksDB state store.
    """
    rows = stream.select("run_id", "stage", "seq", "kind", "attempt")
    return rows.groupBy("run_id", "stage").transformWithStateInPandas(LateResultGuard(page, expire_ms, held), GUARD_SCHEMA, "append", "processingTime")


def _commits(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/committed")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def committing_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: a batch's rows by verdict, then one manifest with its row counts.

    The manifest is renamed into place after the rows are written, and a batch whose manifest exists is not written again, so a batch that is
    repeated after a failure neither overwrites nor doubles anything that readers of ``committed`` have seen.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder, files = _commits(spark, path)
        hadoop = spark._jvm.org.apache.hadoop.fs
        manifest = hadoop.Path(f"{path}/committed/{batch_id}.json")
        if files.exists(manifest):
            return
        rows = f"{path}/rows/batch={batch_id}"
        batch.write.mode("overwrite").partitionBy("verdict").parquet(rows)
        counts = {r["verdict"]: r["n"] for r in spark.read.schema(batch.schema).parquet(rows).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        files.mkdirs(folder)
        started = hadoop.Path(f"{path}/committed/.{batch_id}.json.started")
        out = files.create(started, True)
        out.write(bytearray(json.dumps({"batch": batch_id, "rows": counts}, sort_keys=True).encode()))
        out.close()
        files.rename(started, manifest)

    return write


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the batches that have a manifest."""
    folder, files = _commits(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    batches = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
    wanted = spark.createDataFrame([(b,) for b in batches], "batch bigint")
    if not batches:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={b}" for b in sorted(batches)])
    return rows.join(F.broadcast(wanted), "batch", "left_semi").drop("batch") if "batch" in rows.columns else rows
