"""Arithmetic on maps of counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(m: Column) -> Column:
    return F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _on_common_keys(a: Column, b: Column, f) -> Column:
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNotNull() & y.isNotNull(), f(x, y)))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def merge_sum(a: Column, b: Column) -> Column:
    """Sums by key; a key of one side keeps its value."""
    return F.map_zip_with(a, b, lambda k, x, y: _zero(x) + _zero(y))


def common_min(a: Column, b: Column) -> Column:
    return _on_common_keys(a, b, F.least)


def common_min_share(a: Column, b: Column, extra: float = 1.0) -> Column:
    """Smaller over larger (plus extra) on the keys of both."""
    return _on_common_keys(a, b, lambda x, y: F.least(x, y) / (F.greatest(x, y) + F.lit(extra)))


def difference(a: Column, b: Column) -> Column:
    """Absolute differences over the keys of either side."""
    return F.map_zip_with(a, b, lambda k, x, y: F.abs(_zero(x) - _zero(y)))


def difference_of_left(a: Column, b: Column) -> Column:
    """Absolute differences over the keys of the left side."""
    return F.map_from_entries(F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), F.abs(e["value"] - _zero(F.try_element_at(b, e["key"]))).alias("value"))))


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.map_zip_with(a, b, lambda k, x, y: (_zero(x) * _zero(y)).cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either map is empty."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.transform_values(difference(a, b), lambda k, v: (v * v).cast("double")))


def pairs_as_tokens(m: Column) -> Column:
    """Entries written as key=value, lower-cased, spaces as underscores."""
    return F.transform(F.map_entries(m), lambda e: F.replace(F.lower(F.concat_ws("=", e["key"], e["value"])), F.lit(" "), F.lit("_")))
