"""Input shapes derived from the driver tables, each with the same derivation as a SQL common table expression.

Every derivation is a row-wise projection, an explode or a combinable aggregate, so its work and its number of
keys grow with the table; none numbers rows with a window over an unbounded group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTES: dict[str, str] = {}


def sql(body: str) -> str:
    """Prefix ``body`` with the common table expressions it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    clauses = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {clauses}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys before its rows are multiplied or turned into much work: a small file is one split, so one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# --- rasters ---------------------------------------------------------------------------------------------------

def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 64-wide RGBA images: 64 consecutive vectors are the rows of one image."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 64").alias("image_id"),
        F.expr("cast(vec_id % 64 as int)").alias("y"),
        F.posexplode("embedding").alias("x", "sample"),
    )
    return rows.select(
        "image_id", "x", "y",
        F.expr("(7 * x + y) % 256").alias("r"),
        F.expr("(5 * y + x) % 256").alias("g"),
        F.expr("(x * y) % 256").alias("b"),
        F.expr("least(255, greatest(0, cast(floor(cast(sample as double) * 1200) as int) + 31))").alias("a"),
    )


CTES["px"] = """
SELECT image_id, x, y, (7 * x + y) % 256 AS r, (5 * y + x) % 256 AS g, (x * y) % 256 AS b,
       least(255, greatest(0, CAST(floor(CAST(sample AS DOUBLE) * 1200) AS INT) + 31)) AS a
FROM (SELECT vec_id // 64 AS image_id, vec_id % 64 AS y,
             unnest(range(0, len(embedding))) AS x, unnest(embedding) AS sample FROM embeddings)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared geometry of ``pixels`` without exploding a single pixel."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.expr("vec_id div 64").alias("image_id"))
        .agg(F.max(F.size("embedding")).alias("width"), (F.max(F.expr("vec_id % 64")) + 1).alias("height"))
    )


CTES["img"] = """
SELECT vec_id // 64 AS image_id, max(len(embedding)) AS width, max(vec_id % 64) + 1 AS height
FROM embeddings GROUP BY 1"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id", "x", "y", F.col("a").alias("v"))


CTES["mask_a"] = "SELECT image_id, x, y, a AS v FROM px"


def shifted_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mask moved three columns to the right, kept on the canvas."""
    return mask(spark, sf_dir).where("x + 3 < 64").withColumn("x", F.col("x") + 3)


CTES["mask_b"] = "SELECT image_id, x + 3 AS x, y, v FROM mask_a WHERE x + 3 < 64"


# --- layered pixels --------------------------------------------------------------------------------------------

def layer_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse layers on 16x16 canvases, one image per supplier, one row per (pixel, draw order).

    Colours are packed into one BIGINT so that the de-duplication is a hash aggregate with map-side combine.
    """
    packed = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        F.expr("l_partkey % 16").alias("x"),
        F.expr("l_orderkey % 16").alias("y"),
        F.col("l_linenumber").alias("draw_order"),
        F.expr(
            "((((cast(l_quantity as bigint) * 5) % 256 * 256 + (l_partkey * 7 + l_orderkey) % 256) * 256"
            " + (l_orderkey * 3) % 256) * 256 + cast(floor(l_extendedprice) as bigint) % 256) * 4"
            " + (l_partkey div 16) % 4"
        ).alias("packed"),
    )
    unique = packed.groupBy("image_id", "x", "y", "draw_order").agg(F.min("packed").alias("packed"))
    return unique.select(
        "image_id", "x", "y", "draw_order",
        F.expr("shiftright(packed, 26)").alias("r"),
        F.expr("shiftright(packed, 18) & 255").alias("g"),
        F.expr("shiftright(packed, 10) & 255").alias("b"),
        F.expr("shiftright(packed, 2) & 255").alias("a"),
        F.expr("packed & 3").alias("depth"),
    )


CTES["lpx"] = """
SELECT image_id, x, y, draw_order, packed >> 26 AS r, (packed >> 18) & 255 AS g, (packed >> 10) & 255 AS b,
       (packed >> 2) & 255 AS a, packed & 3 AS depth
FROM (SELECT l_suppkey AS image_id, l_partkey % 16 AS x, l_orderkey % 16 AS y, l_linenumber AS draw_order,
             min(((((CAST(l_quantity AS BIGINT) * 5) % 256 * 256 + (l_partkey * 7 + l_orderkey) % 256) * 256
             + (l_orderkey * 3) % 256) * 256 + CAST(floor(l_extendedprice) AS BIGINT) % 256) * 4
             + (l_partkey // 16) % 4) AS packed
      FROM lineitem GROUP BY 1, 2, 3, 4)"""


def source_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense 16x16 source image that belongs to each supplier's layers."""
    grid = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("image_id"), F.explode(F.expr("sequence(0, 255)")).alias("cell"))
        .select("image_id", F.expr("cast(cell % 16 as bigint)").alias("x"), F.expr("cast(cell div 16 as bigint)").alias("y"))
    )
    return grid.select(
        "image_id", "x", "y",
        F.expr("(3 * x + image_id) % 256").alias("r"),
        F.expr("(5 * y + image_id) % 256").alias("g"),
        F.expr("(7 * (x + y)) % 256").alias("b"),
        F.expr("least(255, (x * 37 + y * 101 + image_id * 13) % 320)").alias("a"),
    )


CTES["spx"] = """
SELECT image_id, x, y, (3 * x + image_id) % 256 AS r, (5 * y + image_id) % 256 AS g, (7 * (x + y)) % 256 AS b,
       least(255, (x * 37 + y * 101 + image_id * 13) % 320) AS a
FROM (SELECT s_suppkey AS image_id, cell % 16 AS x, cell // 16 AS y
      FROM supplier, (SELECT unnest(range(0, 256)) AS cell))"""
