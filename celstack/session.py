"""Session helpers: runtime tuning and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable SQL options that every plan relies on. Skewed join partitions are split even where that
# costs one more shuffle, because a single image, project or session may hold a large share of all rows. Sides are
# broadcast by measured size only: estimates from files know neither exploded rows nor how well a table is compressed.
# Shuffled rows of keys and flags are ten to twenty times larger in memory, so what one task reads is 16 MB, not 64.
RUNTIME_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("celstack")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local folder only where it is unset on a local master."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        known = tempfile.mkdtemp(prefix="spark-celstack-")
        context.setCheckpointDir(known)
    return known


CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clear: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor never replays a loop, and unlike an in-memory checkpoint the table has
    exact sizes for join planning and carries no constraints that would grow from round to round. With ``clear`` the shuffle
    files of the write go with its end, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAR, None)
    if clear:
        spark.conf.set(CLEAR, "true")
    try:
        df.write.parquet(path)
    finally:
        if clear and before is None:
            spark.conf.unset(CLEAR)
        elif clear:
            spark.conf.set(CLEAR, before)
    return spark.read.schema(df.schema).parquet(path)
