"""Ordered scans (running aggregates, lag, row numbers) that survive a key holding a large share of all rows.

A plain window puts each key into one task. Here a key is cut into buckets that follow the ordering (an hour of
event time, a block of positions): one window runs inside each (key, bucket), a small per-bucket summary is
aggregated with map-side combine, and a second window over the summaries carries totals across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = "__key"


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str, value: Column, how: str,
            exclusive: bool = False) -> DataFrame:
    """Running ``sum``, ``count``, ``max``, ``min`` or ``last`` (ignoring nulls) of ``value`` per key.

    ``order`` must be a total order inside a key and ``bucket`` must not decrease along it.
    """
    # One struct carries the key and its bucket: structs with null fields compare equal, so a null key is a key like any
    # other, and window, summary and join all hash the same expression, so the rows are shuffled once.
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("bucket"))
    base = df.withColumn(_KEY, key).withColumn("__value", value)
    end = -1 if exclusive else 0
    local = Window.partitionBy(_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*[f"{_KEY}.k{i}" for i in range(len(keys))]).orderBy(f"{_KEY}.bucket").rowsBetween(Window.unboundedPreceding, -1)
    v, t, c, l = F.col("__value"), F.col("__total"), F.col("__carry"), F.col("__local")
    if how in ("sum", "count"):
        fold, total, carried = (F.sum if how == "sum" else F.count)(v), (F.sum(v) if how == "sum" else F.count(v)), F.sum(t)
        merged = F.coalesce(c, F.lit(0)) + F.coalesce(l, F.lit(0))
    elif how in ("max", "min"):
        pick = F.max if how == "max" else F.min
        fold, total, carried = pick(v), pick(v), pick(t)
        merged = F.greatest(c, l) if how == "max" else F.least(c, l)
    elif how == "last":
        fold, total = F.last(v, ignorenulls=True), F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
        carried, merged = F.last(t, ignorenulls=True), F.coalesce(l, c)
    else:
        raise ValueError(how)
    totals = base.groupBy(_KEY).agg(total.alias("__total"))
    carry = totals.select(_KEY, carried.over(across).alias("__carry"))
    scanned = base.withColumn("__local", fold.over(local))
    return scanned.join(carry, _KEY, "left").withColumn(name, merged).drop("__local", "__carry", "__value", _KEY)


def row_number(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """1-based position inside each key."""
    return running(df, keys, bucket, order, name, F.lit(1).cast("bigint"), "sum")


def lag(df: DataFrame, keys: list[str], bucket: Column, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Previous row's values; ``columns`` maps output names to input columns, null on the first row of a key."""
    previous = running(df, keys, bucket, order, "__previous", F.struct(*[F.col(c) for c in columns.values()]), "last", exclusive=True)
    fields = [F.col(f"__previous.{c}").alias(out) for out, c in columns.items()]
    return previous.select("*", *fields).drop("__previous")
