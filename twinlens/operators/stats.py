"""The eight-number summary of the values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(c: Column, prefix: str = "") -> list[Column]:
    """min, quartiles, mean, max, population deviation, skewness and excess kurtosis;
    without variance the last two are 0 and -3."""
    sd = F.stddev_pop(c)
    return [x.alias(prefix + n) for n, x in (
        ("min", F.min(c)), ("p25", F.percentile(c, 0.25)), ("mean", F.avg(c)), ("p75", F.percentile(c, 0.75)), ("max", F.max(c)),
        ("std", sd), ("skew", F.when(sd == 0, 0.0).otherwise(F.skewness(c))), ("kurtosis", F.when(sd == 0, -3.0).otherwise(F.kurtosis(c))))]


def summaries(df: DataFrame, keys: list[str], c: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*summary(c))


def clip_and_scale(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """column clipped to its quantiles and standardised by the clipped values; the
    scale is one row."""
    q = df.agg(F.percentile(column, low).alias("lo"), F.percentile(column, high).alias("hi"))
    clipped = df.crossJoin(F.broadcast(q)).withColumn(column, F.least(F.greatest(F.col(column), "lo"), F.col("hi"))).drop("lo", "hi")
    scale = clipped.agg(F.avg(column).alias("mu"), F.stddev_samp(column).alias("sd"))
    return clipped.crossJoin(F.broadcast(scale)).withColumn(column, (F.col(column) - F.col("mu")) / F.col("sd")).drop("mu", "sd")
