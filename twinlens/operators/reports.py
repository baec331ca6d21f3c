"""Reports of image pairs whose key names say what was measured between which images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept
from .stats import summary

#: Comparisons of histograms, as key names have them.
HISTOGRAMS = ("SUM_SQUARE", "CHI_SQUARE", "COSINE_DIST", "JACCARD_DISTANCE", "HAMMING", "CORRELATION", "BHATTACHARYYA")
METRICS = ("kp_diff", "kp_matched", *(f"hist_{h.lower()}" for h in HISTOGRAMS))


def parsed_keys(reports: DataFrame) -> DataFrame:
    """id_1, id_2, kind, im1, im2, value: an entry a row. Keys of reports' map `values` are
    ad1_<image>_kp_no and ad2_<image>_kp_no (kinds ad1 and ad2, im2 null),
    keypoints_<from>_<to>_<image>_<image> (kp_matched), and hist_<image>_<image>_<NAME>
    (hist_ and the name in lower case); others are left out."""
    rows = reports.select("id_1", "id_2", F.explode("values").alias("key", "value"))
    part = lambda pattern, k: F.regexp_extract("key", pattern, k)
    points, matched, hist = r"^(ad[12])_([^_]+)_kp_no$", r"^keypoints_\d_\d_([^_]+)_([^_]+)$", r"^hist_([^_]+)_([^_]+)_(\w+)$"
    is_points, is_matched, is_hist = (F.col("key").rlike(p) for p in (points, matched, hist))
    kind = F.when(is_points, part(points, 1)).when(is_matched, F.lit("kp_matched")).when(is_hist, F.concat(F.lit("hist_"), F.lower(part(hist, 3))))
    im1 = F.when(is_points, part(points, 2)).when(is_matched, part(matched, 1)).otherwise(part(hist, 1))
    im2 = F.when(is_matched, part(matched, 2)).when(is_hist, part(hist, 2))
    return rows.select("id_1", "id_2", kind.alias("kind"), im1.alias("im1"), im2.alias("im2"), F.col("value").cast("double").alias("value")).where("kind is not null")


def pair_metrics(reports: DataFrame, signatures: DataFrame) -> DataFrame:
    """id_1, id_2 and eight numbers for each of METRICS: differences of numbers of key points,
    matched ones, and comparisons of histograms, over all images of both sides but for those
    whose signature (image, signature) both sides have. All are null where a side has no image
    left; images without a signature have one in common."""
    ids = ["id_1", "id_2"]
    rows = kept(parsed_keys(reports), "report-keys")
    images = rows.where(F.col("kind").isin("ad1", "ad2")).join(signatures.select(F.col("image").cast("string").alias("im1"), F.col("signature").cast("string").alias("signature")), "im1", "left").fillna("", ["signature"])
    shared = images.groupBy(*ids, "signature").agg(F.count_distinct("kind").alias("sides")).where("sides = 2")
    same = images.join(shared, [*ids, "signature"], "left_semi").select(*ids, F.col("im1").alias("image")).distinct()
    without = lambda df, c: df.join(same.withColumnRenamed("image", c), [*ids, c], "left_anti")
    left = without(images, "im1")
    sides = [left.where(F.col("kind") == f"ad{n}").select(*ids, F.col("value").alias(f"v{n}")) for n in (1, 2)]
    points = sides[0].join(sides[1], ids).select(*ids, F.lit("kp_diff").alias("kind"), F.abs(F.col("v1") - F.col("v2")).alias("value"))
    others = without(without(rows.where(~F.col("kind").isin("ad1", "ad2")), "im1"), "im2").select(*ids, "kind", "value")
    both = points.select(*ids).distinct()
    long = points.unionByName(others.join(both, ids, "left_semi"))
    wide = long.groupBy(*ids).pivot("kind", list(METRICS)).agg(*summary(F.col("value")))
    return reports.select(*ids).join(wide, ids, "left")
