"""Queries on vectors, contacts and maps, with their SQL.

The vectors of embeddings stand for the parts of an item: vector v belongs to item
v div 4, and neighbouring items are the pairs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, maps
from ..operators import learning, vectors
from ..sources.kept import kept
from .catalog import _read, query

_STATS = ("min", "p25", "mean", "p75", "max", "std", "skew", "kurtosis")


def _parts(spark, d):
    return _read(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("item"), "vec_id", "embedding")


def _item_pairs(parts):
    ids = parts.select(F.col("item").alias("id_1")).distinct()
    return ids.select("id_1", (F.col("id_1") + 1).alias("id_2"))


_CROSSED = """
v AS (SELECT vec_id // 4 AS item, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
x AS (SELECT a.item AS id_1, b.item AS id_2, a.vec_id AS v_1, b.vec_id AS v_2, a.e AS a, b.e AS b FROM v a JOIN v b ON b.item = a.item + 1)"""


def _summary_sql(name: str) -> str:
    return f"""min({name}) AS {name}_min, quantile_cont({name}, 0.25) AS {name}_p25, avg({name}) AS {name}_mean, quantile_cont({name}, 0.75) AS {name}_p75,
  max({name}) AS {name}_max, stddev_pop({name}) AS {name}_std,
  CASE WHEN stddev_pop({name}) = 0 THEN 0.0 ELSE avg(power({name} - {name}_mu, 3)) / power(stddev_pop({name}), 3) END AS {name}_skew,
  CASE WHEN stddev_pop({name}) = 0 THEN -3.0 ELSE avg(power({name} - {name}_mu, 4)) / power(stddev_pop({name}), 4) - 3 END AS {name}_kurtosis"""


def _rounded(df, metrics):
    return df.select("id_1", "id_2", *[F.round(F.col(f"{m}_{s}").cast("double"), 6).alias(f"{m}_{s}") for m in metrics for s in _STATS])


def _summaries_sql(metrics: dict[str, str]) -> str:
    columns = ", ".join(f"round({m}_{s}::DOUBLE, 6) AS {m}_{s}" for m in metrics for s in _STATS)
    values = ", ".join(f"({sql}) AS {m}" for m, sql in metrics.items())
    means = ", ".join(f"avg({m}) OVER (PARTITION BY id_1) AS {m}_mu" for m in metrics)
    return f"""WITH {_CROSSED}, d AS (SELECT id_1, id_2, {values} FROM x), m AS (SELECT *, {means} FROM d),
s AS (SELECT id_1, id_2, {', '.join(map(_summary_sql, metrics))} FROM m GROUP BY ALL) SELECT id_1, id_2, {columns} FROM s"""


_DIFF = "list_transform(range(1, len(a) + 1), lambda i: a[i] - b[i])"


@query("i11_descriptor_distances", _summaries_sql({
    "euclidean": f"list_sum(list_transform({_DIFF}, lambda t: t * t))", "manhattan": f"list_sum(list_transform({_DIFF}, lambda t: abs(t)))",
    "cosine": "list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))"}))
def descriptor_distances(spark, d):
    parts = _parts(spark, d)
    a, b = F.col("embedding_1"), F.col("embedding_2")
    metrics = {"euclidean": vectors.squared_euclidean(a, b), "manhattan": vectors.manhattan(a, b), "cosine": vectors.cosine(a, b)}
    return _rounded(vectors.pair_summaries(vectors.all_pairs(_item_pairs(parts), parts, "item", "vec_id"), metrics), metrics)


@query("i09_hash_distances", _summaries_sql({
    "hamming": "len(list_filter(range(1, len(a) + 1), lambda i: (a[i] >= 0) <> (b[i] >= 0)))", "shared": "len(list_filter(range(1, len(a) + 1), lambda i: a[i] >= 0 AND b[i] >= 0))"}))
def hash_distances(spark, d):
    parts = _parts(spark, d).select("item", "vec_id", vectors.sign_bits(F.col("embedding")).alias("h"))
    a, b = F.col("h_1"), F.col("h_2")
    metrics = {"hamming": vectors.hamming(a, b), "shared": vectors.shared_ones(a, b)}
    return _rounded(vectors.pair_summaries(vectors.all_pairs(_item_pairs(parts), parts, "item", "vec_id"), metrics), metrics)


_DEV = "list_transform({0}, lambda t: t - list_sum({0}) / len({0}))"


@query("d14_correlations", f"""
WITH {_CROSSED}, c AS (SELECT id_1, v_1, v_2, {_DEV.format('a')} AS p, {_DEV.format('b')} AS q FROM x),
s AS (SELECT *, list_transform(p, lambda t: t * t) AS pp, list_transform(q, lambda t: t * t) AS qq FROM c)
SELECT v_1, v_2, round(list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)), 6) AS correlation,
  round(list_dot_product(pp, qq) / (list_sum(pp) * list_sum(qq)), 6) AS cokurtosis FROM s""")
def correlations(spark, d):
    parts = _parts(spark, d)
    a, b = F.col("embedding_1"), F.col("embedding_2")
    crossed = vectors.all_pairs(_item_pairs(parts), parts, "item", "vec_id")
    return crossed.select(F.col("vec_id_1").alias("v_1"), F.col("vec_id_2").alias("v_2"), F.round(vectors.correlation(a, b), 6).alias("correlation"), F.round(vectors.cokurtosis(a, b), 6).alias("cokurtosis"))


@query("d16_relaxed_transport", f"""
WITH {_CROSSED}, d AS (SELECT id_1, id_2, v_1, v_2, list_sum(list_transform({_DIFF}, lambda t: t * t)) AS d FROM x),
l AS (SELECT id_1, id_2, min(d) AS least FROM d GROUP BY id_1, id_2, v_1 UNION ALL SELECT id_1, id_2, min(d) FROM d GROUP BY id_1, id_2, v_2)
SELECT id_1, id_2, round(sum(least) / 2, 6) AS sym, round(avg(least), 6) AS mean FROM l GROUP BY ALL""")
def relaxed_transport(spark, d):
    parts = _parts(spark, d)
    crossed = vectors.all_pairs(_item_pairs(parts), parts, "item", "vec_id")
    out = vectors.relaxed_transport(crossed, "vec_id", vectors.squared_euclidean(F.col("embedding_1"), F.col("embedding_2")))
    return out.select("id_1", "id_2", F.round("sym", 6).alias("sym"), F.round("mean", 6).alias("mean"))


_TLD_SQL = ", ".join(f"'{t}'" for t in contact.TLDS)
_PREPARED = "lower(coalesce(text, ''))"
for _old, _new in contact._REWRITES:
    _PREPARED = f"replace({_PREPARED}, '{_old}', '{_new}')"
_MAIL = "t"
for _old, _new in contact._MAIL_REWRITES:
    _MAIL = f"replace({_MAIL}, '{_old}', '{_new}')"


@query("c03_contacts", f"""
WITH p AS (SELECT doc_id, {_PREPARED} AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(regexp_extract_all({_MAIL}, '{contact.EMAIL}'), lambda x: string_split(x, '.')[-1] IN ({_TLD_SQL})), ' ') AS emails,
  array_to_string(list_transform(regexp_extract_all(t, '{contact.PHONE}'), lambda x: '+7' || right(regexp_replace(x, '[^0-9]', '', 'g'), 10)), ' ') AS phones,
  array_to_string(regexp_extract_all(t, '{contact.HASHTAG}'), ' ') AS hashtags, array_to_string(regexp_extract_all(t, '{contact.PLACEHOLDER}'), ' ') AS placeholders FROM p""")
def contacts(spark, d):
    found = contact.contacts(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", *[F.array_join(found[n], " ").alias(n) for n in ("emails", "phones", "hashtags", "placeholders")])


@query("c02_links", f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '{contact.ADDRESS}', ' ', 'g'), '\\./|/\\.', '/', 'g') AS t FROM pages),
l AS (SELECT page_id, list_transform(regexp_extract_all(t, '{contact.LINK}'), lambda x: regexp_replace(regexp_replace(x, '^(https?://)?(www\\.)?', ''), '/+$', '')) AS l FROM p)
SELECT page_id, array_to_string(list_filter(l, lambda x: length(x) > 5 AND len(string_split(regexp_extract(x, '^[^/:?#]+'), '.')) <= 3
  AND string_split(regexp_extract(x, '^[^/:?#]+'), '.')[-1] IN ({_TLD_SQL}) AND NOT regexp_matches(string_split(regexp_extract(x, '^[^/:?#]+'), '.')[-2], '^[0-9]')), ' ') AS links FROM l""")
def links(spark, d):
    return _read(spark, d, "pages").select("page_id", F.array_join(contact.links(F.lower(F.coalesce("url", F.lit("")))), " ").alias("links"))


@query("m04_count_maps", """
WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT a.user_id, coalesce(sum(CASE WHEN b.n IS NOT NULL THEN least(a.n, b.n) END), 0.0) AS common, round(coalesce(sum(CASE WHEN b.n IS NOT NULL THEN least(a.n, b.n) END / (greatest(a.n, b.n) + 1)), 0.0), 6) AS common_share
FROM c a JOIN (SELECT DISTINCT user_id FROM events) w ON w.user_id = a.user_id + 1 LEFT JOIN c b ON b.user_id = w.user_id AND b.event_type = a.event_type GROUP BY a.user_id""")
def count_maps(spark, d):
    n = _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # a handful of types
    other = m.select((F.col("user_id") - 1).alias("user_id"), F.col("m").alias("o"))
    a, b = F.col("m"), F.col("o")
    return m.join(other, "user_id").select("user_id", maps.total(maps.common_min(a, b)).alias("common"), F.round(maps.total(maps.common_min_share(a, b)), 6).alias("common_share"))


@query("l02_out_of_fold")
def out_of_fold(spark, d):
    """Scores of the labelled documents by models of the other folds."""
    t = F.col("text")
    features = {"n_chars": F.char_length(t), "n_words": F.size(F.split(t, " ")), "n_distinct": F.size(F.array_distinct(F.split(t, " "))), "n_symbols": F.char_length(F.regexp_replace(t, r"[\pL\pN ]", "")), "n_lines": F.size(F.split(t, "\n"))}
    docs = _read(spark, d, "documents").select("doc_id", *[c.cast("double").alias(n) for n, c in features.items()])
    rows = _read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).join(docs, "doc_id").withColumn("fold", learning.fold("doc_id"))
    rows = kept(rows, "features")  # each fold's scans read these, not the texts
    return learning.out_of_fold(rows, list(features), lambda: learning.LogisticRegression(regParam=0.01)).select("doc_id", "label", "fold", "score")
