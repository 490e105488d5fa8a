"""Bucketed scans equal plain windows, with one key holding most rows."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from celstack.operators import hotkeys


def test_scans_equal_windows(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.choice([None, *range(1, 9)]), i, rng.choice([None, *range(50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, pos bigint, v int")
    bucket = F.expr("pos div 37")
    whole = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("max", F.max("v").over(whole)).withColumn("sum", F.coalesce(F.sum("v").over(whole), F.lit(0))).withColumn(
        "last", F.last("v", True).over(before)).withColumn("lag", F.lag("v").over(Window.partitionBy("k").orderBy("pos"))).withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    scan = hotkeys.running(df, ["k"], bucket, ["pos"], "max", F.col("v"), "max")
    scan = hotkeys.running(scan, ["k"], bucket, ["pos"], "sum", F.col("v"), "sum")
    scan = hotkeys.running(scan, ["k"], bucket, ["pos"], "last", F.col("v"), "last", exclusive=True)
    scan = hotkeys.lag(scan, ["k"], bucket, ["pos"], {"lag": "v"})
    scan = hotkeys.row_number(scan, ["k"], bucket, ["pos"], "rn")
    columns = ["k", "pos", "v", "max", "sum", "last", "lag", "rn"]
    assert sorted(map(repr, (tuple(r) for r in plain.select(columns).collect()))) == sorted(map(repr, (tuple(r) for r in scan.select(columns).collect())))
