"""Nested descriptions of images as scalar columns, by a tree of rules: a name leads to a
subtree, or to the columns that its text holds and how each is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from ..functions import parsers

_number = lambda c: c.try_cast("double")
_first, _second = (lambda c: parsers.value_and_norm(c)[0]), (lambda c: parsers.value_and_norm(c)[1])
_left, _right = (lambda c: F.get(F.split(c, ","), F.lit(0)).try_cast("double")), (lambda c: F.get(F.split(c, ","), F.lit(1)).try_cast("double"))

# Names in the descriptions, and of the columns they give.
MOMENTS = {
    "Ellipse Semi-Major/Minor axis": {"ellipse_major": _left, "ellipse_minor": _right},
    "Ellipse eccentricity": {"ellipse_eccentricity": _number},
    "Ellipse intensity": {"ellipse_intensity": _second},
    "Ellipse angle": {"ellipse_angle": _number},
    "Centroid": {"ellipse_centroid_x": _left, "ellipse_centroid_y": _right},
} | {f"I{i}": {f"I{i}_1": _first, f"I{i}_2": _second} for i in range(1, 9)}
STATISTICS = {
    "skewness": {"skewness": _number}, "min": {"min": _second}, "max": {"max": _second}, "mean": {"mean": _second},
    "standard deviation": {"std": _second}, "entropy": {"entropy": _number}, "kurtosis": {"kurtosis": _number},
}
COLOURS, GREY = ("Red", "Green", "Blue"), "Gray"
GREY_TYPES = ("Grayscale", "Bilevel")
HASHES = tuple(f"PH{i}" for i in range(1, 8))


def _fields(rules: dict) -> StructType:
    return StructType([StructField(n, StringType()) for n in rules])


def schema() -> StructType:
    """Of a description as JSON."""
    channels = lambda rules: StructType([StructField(n, _fields(rules)) for n in (*COLOURS, GREY)])
    overall = lambda rules: StructType([StructField("Overall", _fields(rules))])
    return StructType([
        StructField("Type", StringType()), StructField("Image moments", overall(MOMENTS)), StructField("Channel moments", channels(MOMENTS)),
        StructField("Image statistics", overall(STATISTICS)), StructField("Channel statistics", channels(STATISTICS)),
        StructField("Channel perceptual hash", MapType(StringType(), MapType(StringType(), StringType()))),
        StructField("Number pixels", StringType()), StructField("Filesize", StringType()), StructField("Geometry", StringType()),
    ])


def flattened(c: Column, rules: dict, prefix: str) -> dict[str, Column]:
    """Columns prefix_name for all leaves of the tree."""
    out = {}
    for name, below in rules.items():
        field = c.getField(name)
        if any(isinstance(x, dict) for x in below.values()):
            out |= flattened(field, below, f"{prefix}_{name}")
        else:
            out |= {f"{prefix}_{n}": read(field) for n, read in below.items()}
    return out


def image_scalars(c: Column, hash_keys: list[str]) -> dict[str, Column]:
    """The columns of a parsed description: moments and statistics overall and of three colours, for
    which grey images have those of their only channel; hash_keys: names of perceptual hashes,
    two channels with a comma each; pixels, bytes and geometry. What is missing or cannot be read
    is null."""
    grey, out = c.getField("Type").isin(*GREY_TYPES), {}
    for prefix, group, rules in (("moments", "moments", MOMENTS), ("imstat", "statistics", STATISTICS)):
        channels, overall = c.getField(f"Channel {group}"), c.getField(f"Image {group}").getField("Overall")
        for name, own in (("overall", overall), *((n.lower(), channels.getField(n)) for n in COLOURS)):
            out |= flattened(F.when(grey, channels.getField(GREY)).otherwise(own), rules, f"{prefix}_{name}")
    for key in hash_keys:
        two = key.lower().split(", ")
        for h in HASHES:
            text = F.try_element_at(F.try_element_at(c.getField("Channel perceptual hash"), F.lit(key)), F.lit(h))
            out |= {f"phash_{n}_{h.lower()}": read(text) for n, read in zip(two, (_left, _right))}
    geometry = c.getField("Geometry")
    return out | {"no_pixels": parsers.pixels(c.getField("Number pixels")), "filesize": parsers.file_size(c.getField("Filesize")), "geometry": F.substring(geometry, F.lit(1), F.char_length(geometry) - 4), "type": c.getField("Type")}
