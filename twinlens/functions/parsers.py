"""Parsers of small notations inside strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def listed(c: Column) -> Column:
    """The entries of a comma-separated list, stripped; entries without a character are
    left out, null is empty."""
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != ""), lambda x: F.trim(x))


def report(c: Column, prefix: str = "") -> Column:
    """'"k"=>"v", ...' as a map, keys with a prefix, empty values as NA; entries without an
    arrow are left out, and of entries with one key the last one counts."""
    entries = F.filter(F.split(F.coalesce(c, F.lit("")), ", "), lambda e: F.contains(e, F.lit("=>")))
    bare = lambda x: F.btrim(x, F.lit('"'))
    pair = lambda e: F.struct(F.concat(F.lit(prefix), bare(F.substring_index(e, "=>", 1))).alias("key"), F.coalesce(F.nullif(bare(F.substring_index(e, "=>", -1)), F.lit("")), F.lit("NA")).alias("value"))

    def last(found):
        keys = F.transform(found, lambda e: e["key"])
        return F.filter(found, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))

    return F.map_from_entries(bind(F.transform(entries, pair), last))


def value_and_norm(c: Column) -> tuple[Column, Column]:
    """'v (n)' as two numbers."""
    found = lambda k: F.regexp_extract(c, r"^\s*(\S+)\s+\(([^)]*)\)", k).try_cast("double")
    return found(1), found(2)


#: Bytes of a unit of size.
UNITS = {"KB": 1024.0, "MB": 1024.0 * 1024.0, "B": 1.0}


def file_size(c: Column) -> Column:
    """'12KB', '1.5MB' or '7B' in bytes; null for anything else."""
    out = F.lit(None).cast("double")
    for unit, size in reversed(UNITS.items()):
        out = F.when(F.endswith(c, F.lit(unit)), F.substring(c, F.lit(1), F.char_length(c) - len(unit)).try_cast("double") * size).otherwise(out)
    return out


def pixels(c: Column) -> Column:
    """'12K' as 12000; a plain number is itself."""
    thousand = F.endswith(c, F.lit("K"))
    return F.when(thousand, F.substring(c, F.lit(1), F.char_length(c) - 1).try_cast("double") * 1000.0).otherwise(c.try_cast("double"))
