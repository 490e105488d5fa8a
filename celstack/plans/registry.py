"""Registry of named queries: a Spark builder, an output schema, and (where possible) an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        df = self.build(spark, sf_dir)
        return df.select(*[F.col(name).cast(SPARK_TYPES[kind]).alias(name) for name, kind in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(f"CAST({name} AS {SQL_TYPES[kind]}) AS {name}" for name, kind in self.columns)
        return f"SELECT {casts} FROM ({self.sql}) AS result"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)``; ``columns`` is ``"name:kind ..."`` with kinds l, d, s, b."""
    parsed = tuple(tuple(item.split(":")) for item in columns.split())

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, parsed, sql)
        return build

    return wrap
