"""Reports of image pairs, written as JSON lines from `embeddings` and parsed by key names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata, reports, vectors
from .catalog import _read, query
from .measures import _HIST, _ZIP
from .vector_queries import _CROSSED, _STATS, _item_pairs, _parts, _summary_sql

#: Images whose ids leave the same rest have one signature.
_SIGNS, _LIMIT, _DIGITS = 7, 0.1, 4
_COUNT = "len(list_filter({0}, lambda t: t > {1}))::DOUBLE"
_MEAN = "list_transform({0}, lambda t: t - list_avg({0}))"
_VALUES = {
    "hist_sum_square": _ZIP.format("(a[i] - b[i]) * (a[i] - b[i])"),
    "hist_chi_square": _ZIP.format("CASE WHEN a[i] + b[i] = 0 THEN 0.0 ELSE (a[i] - b[i]) * (a[i] - b[i]) / (a[i] + b[i]) END"),
    "hist_cosine_dist": f"1 - {_ZIP.format('a[i] * b[i]')} / sqrt({_ZIP.format('a[i] * a[i]')} * {_ZIP.format('b[i] * b[i]')})",
    "hist_jaccard_distance": f"1 - {_ZIP.format('(a[i] > 0 AND b[i] > 0)::INT')} / {_ZIP.format('(a[i] > 0 OR b[i] > 0)::INT')}",
    "hist_hamming": _ZIP.format("(a[i] <> b[i])::INT"),
    "hist_correlation": f"list_dot_product({_MEAN.format('a')}, {_MEAN.format('b')}) / sqrt(list_dot_product({_MEAN.format('a')}, {_MEAN.format('a')}) * list_dot_product({_MEAN.format('b')}, {_MEAN.format('b')}))",
    "hist_bhattacharyya": f"1 - {_ZIP.format('sqrt(a[i] * b[i])')} / sqrt(list_sum(a) * list_sum(b))",
}
_BOTH = f"len(list_filter(range(1, len(p) + 1), lambda i: {{0}} > {_LIMIT} AND {{1}} > {_LIMIT}))::DOUBLE"
_KINDS = {"kp_diff": f"abs({_COUNT.format('p', _LIMIT)} - {_COUNT.format('q', _LIMIT)})"} | _VALUES
_LONG = " UNION ALL ".join(f"SELECT id_1, id_2, '{k}' AS kind, round({v}, {_DIGITS}) AS value FROM y" for k, v in [*_KINDS.items(), ("kp_matched", _BOTH.format("p[i]", "q[i]")), ("kp_matched", _BOTH.format("-p[i]", "-q[i]"))])


@query("i17_pair_reports", f"""
WITH {_CROSSED}, g AS (SELECT vec_id // 4 AS item, list(vec_id % {_SIGNS}) AS signs FROM embeddings GROUP BY 1),
y AS (SELECT id_1, id_2, a AS p, b AS q, {_HIST.format('a')} AS a, {_HIST.format('b')} AS b FROM x JOIN g g1 ON g1.item = id_1 JOIN g g2 ON g2.item = id_2 WHERE NOT list_contains(g2.signs, v_1 % {_SIGNS}) AND NOT list_contains(g1.signs, v_2 % {_SIGNS})),
d AS ({_LONG}), m AS (SELECT *, avg(value) OVER (PARTITION BY id_1, id_2, kind) AS value_mu FROM d),
s AS (SELECT id_1, id_2, kind, {_summary_sql('value')} FROM m GROUP BY ALL), e AS (SELECT DISTINCT id_1, id_2 FROM x)
SELECT e.id_1, e.id_2, {', '.join(f"max(CASE WHEN kind = '{k}' THEN round(value_{s}::DOUBLE, 8) + 0.0 END) AS {k}_{s}" for k in reports.METRICS for s in _STATS)}
FROM e LEFT JOIN s ON s.id_1 = e.id_1 AND s.id_2 = e.id_2 GROUP BY ALL""")
def pair_reports(spark, d):
    """72 columns: eight numbers of differences of key points, matched ones and seven
    histogram comparisons, over pairs of images that both sides do not share."""
    parts = _parts(spark, d).withColumn("e", F.transform("embedding", lambda t: t.cast("double")))
    parts = parts.select("item", "vec_id", "e", F.transform("e", lambda t: F.floor(F.abs(t) * 20).cast("double")).alias("h"))
    crossed = vectors.all_pairs(_item_pairs(parts), parts, "item", "vec_id")
    a, b, p, q, i, j = (F.col(c) for c in ("h_1", "h_2", "e_1", "e_2", "vec_id_1", "vec_id_2"))
    sums = lambda f: vectors._terms(a, b, f)
    flag = lambda c: c.cast("double")
    over = lambda c: F.size(F.filter(c, lambda t: t > _LIMIT)).cast("double")
    shared = lambda sign: F.aggregate(F.zip_with(p, q, lambda x, y: flag((x * sign > _LIMIT) & (y * sign > _LIMIT))), F.lit(0.0), lambda s, x: s + x)
    values = {
        "SUM_SQUARE": vectors.squared_euclidean(a, b), "CHI_SQUARE": sums(lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / F.nullif(x + y, F.lit(0.0)))), "COSINE_DIST": 1 - vectors.cosine(a, b),
        "JACCARD_DISTANCE": 1 - sums(lambda x, y: flag((x > 0) & (y > 0))) / sums(lambda x, y: flag((x > 0) | (y > 0))), "HAMMING": sums(lambda x, y: flag(x != y)),
        "CORRELATION": vectors.correlation(a, b), "BHATTACHARYYA": 1 - sums(lambda x, y: F.sqrt(x * y)) / F.sqrt(vectors._sum(a) * vectors._sum(b)),
    }
    named = lambda *parts: F.concat_ws("_", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    entries = [(named("ad1", i, "kp_no"), over(p)), (named("ad2", j, "kp_no"), over(q)), (named("keypoints_1_2", i, j), shared(1)), (named("keypoints_2_1", j, i), shared(-1))]
    entries += [(named("hist", i, j, n), v) for n, v in values.items()]
    listed = F.array(*[F.struct(k.alias("key"), F.round(v, _DIGITS).alias("value")) for k, v in entries])
    # a line has an entry a key; an item has four images, so a line is short
    lines = crossed.select("id_1", "id_2", listed.alias("x")).groupBy("id_1", "id_2").agg(F.to_json(F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("x"))))).alias("line"))
    read = lines.select("id_1", "id_2", F.from_json("line", "map<string,double>").alias("values"))
    signatures = parts.select(F.col("vec_id").alias("image"), (F.col("vec_id") % _SIGNS).alias("signature"))
    out = reports.pair_metrics(read, signatures)
    return out.select("id_1", "id_2", *[(F.round(c, 8) + 0.0).alias(c) for c in out.columns[2:]])


#: Where a channel's numbers begin in a vector; the order in which they are taken for names.
_AT = {"Overall": 0, "Red": 12, "Green": 24, "Blue": 36, "Gray": 48}
_HASH_KEYS = ["Red, Hue", "Green, Chroma", "Blue, Luma"]
_PLACES = {"ellipse_major": 1, "ellipse_minor": 2, "ellipse_eccentricity": 3, "ellipse_intensity": 5, "ellipse_angle": 6, "ellipse_centroid_x": 7, "ellipse_centroid_y": 8} | {f"I{i}_{k}": i + k - 1 for i in range(1, 9) for k in (1, 2)}
_STAT_PLACES = {"skewness": 9, "min": 10, "max": 11, "mean": 12, "std": 1, "entropy": 2, "kurtosis": 3}


def _scalars_sql() -> str:
    at = lambda c, k: f"round(embedding[CASE WHEN label % 2 = 0 THEN {_AT['Gray']} ELSE {_AT[c]} END + {k}]::DOUBLE, 6)"
    out = [f"{at(c, k)} AS {p}_{c.lower()}_{n}" for p, places in (("moments", _PLACES), ("imstat", _STAT_PLACES)) for c in list(_AT)[:4] for n, k in places.items()]
    out += [f"round(embedding[{8 * i + j + 32 * side}]::DOUBLE, 6) AS phash_{n}_ph{j}" for i, key in enumerate(_HASH_KEYS) for side, n in enumerate(key.lower().split(", ")) for j in range(1, 8)]
    return ", ".join([*out, "label * 1000.0::DOUBLE AS no_pixels", "vec_id * 1024.0::DOUBLE AS filesize", "'10x' || label AS geometry", "CASE WHEN label % 2 = 0 THEN 'Grayscale' ELSE 'TrueColor' END AS type"])


@query("i18_image_metadata", f"SELECT vec_id, {_scalars_sql()} FROM embeddings")
def image_metadata(spark, d):
    """166 scalar columns of descriptions that are written as JSON from `embeddings`; grey images
    have one channel, which counts for all."""
    number = lambda k: F.round(F.get("embedding", F.lit(k - 1)).cast("double"), 6).cast("string")
    bracket = lambda k: F.concat(number(k), F.lit(" ("), number(k + 1), F.lit(")"))
    only = lambda k: F.concat(F.lit("0 ("), number(k), F.lit(")"))
    comma = lambda j, k: F.concat(number(j), F.lit(", "), number(k))
    grey = F.col("label") % 2 == 0

    def named(entries):
        return F.struct(*[v.alias(n) for n, v in entries.items()])

    def moments(o):
        return named({"Ellipse Semi-Major/Minor axis": comma(o + 1, o + 2), "Ellipse eccentricity": number(o + 3), "Ellipse intensity": bracket(o + 4), "Ellipse angle": number(o + 6), "Centroid": comma(o + 7, o + 8)} | {f"I{i}": bracket(o + i) for i in range(1, 9)})

    def statistics(o):
        return named({"skewness": number(o + 9), "min": only(o + 10), "max": only(o + 11), "mean": only(o + 12), "standard deviation": only(o + 1), "entropy": number(o + 2), "kurtosis": number(o + 3)})

    def channels(of):
        return named({n: F.when(grey if n == "Gray" else ~grey, of(_AT[n])) for n in ("Red", "Green", "Blue", "Gray")})

    hashes = named({key: named({f"PH{j}": comma(8 * i + j, 8 * i + j + 32) for j in range(1, 8)}) for i, key in enumerate(_HASH_KEYS)})
    described = named({
        "Type": F.when(grey, "Grayscale").otherwise("TrueColor"), "Image moments": named({"Overall": moments(0)}), "Channel moments": channels(moments), "Image statistics": named({"Overall": statistics(0)}), "Channel statistics": channels(statistics),
        "Channel perceptual hash": hashes, "Number pixels": F.concat(F.col("label"), F.lit("K")), "Filesize": F.concat(F.col("vec_id"), F.lit("KB")), "Geometry": F.concat(F.lit("10x"), F.col("label"), F.lit("+0+0")),
    })
    lines = _read(spark, d, "embeddings").select("vec_id", F.to_json(described).alias("line"))
    parsed = lines.select("vec_id", F.explode(F.array(F.from_json("line", metadata.schema()))).alias("m"))
    return parsed.select("vec_id", *[c.alias(n) for n, c in metadata.image_scalars(F.col("m"), _HASH_KEYS).items()])
