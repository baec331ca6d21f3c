"""Pairs of items joined to both sides' views, and comparisons of count vectors.

Pairs and items grow together, and Spark takes narrow columns of either for small enough to
be broadcast: joins here ask for merges, so that no side passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_both(pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """pairs (id_1, id_2, ...) left-joined twice to items; columns get _1 and _2."""
    side = lambda n: items.select(*[F.col(c).alias(f"{c}_{n}") for c in items.columns])
    out = pairs
    for n in (1, 2):
        out = out.join(side(n).hint("merge"), out[f"id_{n}"] == F.col(f"{key}_{n}"), "left").drop(f"{key}_{n}")
    return out


def counts(items: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term, n: each item's terms with their counts. Items are dealt by key before they are
    taken apart: a file's terms would all be counted in the task that reads it."""
    dealt = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def cosine(pairs: DataFrame, weights: DataFrame, key: str, value: str = "n") -> DataFrame:
    """pairs' ids with the cosine of their sparse vectors (key, term, value): a join on
    terms for the products, and norms by item; 0 where either has no terms."""
    norms = weights.groupBy(key).agg(F.sum(F.col(value) * F.col(value)).alias("norm"))
    w = lambda n: weights.select(F.col(key).alias(f"id_{n}"), "term", F.col(value).alias(f"v_{n}"))
    dots = pairs.select("id_1", "id_2").join(w(1).hint("merge"), "id_1").join(w(2).hint("merge"), ["id_2", "term"]).groupBy("id_1", "id_2").agg(F.sum(F.col("v_1") * F.col("v_2")).alias("dot"))
    out = pairs.select("id_1", "id_2").join(dots.hint("merge"), ["id_1", "id_2"], "left")
    for n in (1, 2):
        out = out.join(norms.select(F.col(key).alias(f"id_{n}"), F.col("norm").alias(f"norm_{n}")).hint("merge"), f"id_{n}", "left")
    return out.select("id_1", "id_2", F.coalesce(F.col("dot") / F.sqrt(F.col("norm_1") * F.col("norm_2")), F.lit(0.0)).alias("cosine"))
