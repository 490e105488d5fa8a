"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts differ in length by five orders of magnitude, so batches to Python are kept short in rows.
ROWS_PER_BATCH = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Python batches of this session hold at most ``ROWS_PER_BATCH`` rows from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def hashed_sample(rows: DataFrame, column: str, count: int, most: int) -> DataFrame:
    """At most ``most`` of ``count`` rows, those with the smallest hash of ``column``: the same rows whatever the partitions.

    A threshold on the hash leaves about one and a half times as many rows, so that little is sorted and sent however many tasks
    there are.
    """
    place = F.xxhash64(column).bitwiseAND(F.lit((1 << 63) - 1))
    share = (1.5 * most + 200) / max(count, 1)
    near = rows if share >= 1 else rows.where(place < int(share * (1 << 62)) * 2)
    return near.orderBy(place, column).limit(most)


def hinted(ids: DataFrame, most: int = 1 << 21) -> DataFrame:
    """A table of one id column to join large texts with: broadcast if it has at most ``most`` rows (16 MB), else shuffled."""
    return F.broadcast(ids) if ids.count() <= most else ids


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
