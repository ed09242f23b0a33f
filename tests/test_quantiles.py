"""Exact percentiles against Spark's own, which buffer a column."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerline.operators import quantiles as P


def test_percentiles_equal_those_of_a_buffered_column(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    df = spark.range(30_000, numPartitions=4).select(
        h.alias("spread"), F.exp(h / 20_000).alias("skew"), F.when(F.col("id") % 3 > 0, 7.0).otherwise(h).alias("tied"), F.lit(2.5).alias("one"),
        F.when(F.col("id") % 5 == 0, h - 500_000).alias("gaps"), F.when(F.col("id") % 1_000 == 0, 1e300).otherwise(-h).alias("far"), F.lit(None).cast("double").alias("none"),
    )
    wanted = [(c, p) for c in df.columns for p in (0.0, 0.1, 0.5, 0.75, 0.9, 1.0)]
    expected = df.agg(*[F.percentile(c, p).alias(f"{c}{p}") for c, p in wanted]).first()
    for small in (20, P.SMALL):
        assert P.percentiles(df, wanted, small) == [expected[f"{c}{p}"] for c, p in wanted]


def test_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, 3.0), (None, float("nan")), (2.0, float("inf"))], "a double, b double")
    a, b, top = P.percentiles(df, [("a", 0.5), ("b", 0.5), ("b", 1.0)])
    assert (a, b) == (2.0, math.inf) and math.isnan(top)
    assert P.percentiles(df.limit(0), [("a", 0.5)]) == [None]
    many = spark.range(5_000).select(F.when(F.col("id") < 3_000, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("x"))
    assert P.percentiles(many, [("x", 0.2)], 10) == [many.agg(F.percentile("x", 0.2)).first()[0]]
