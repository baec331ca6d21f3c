"""Registered queries and their SQL.

Parts stand for items (p_name is the title) and neighbours in key order for the
pairs, which are an input here as there is no candidate generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import pairs as both
from ..operators import stats, weights

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "part").select(F.col("p_partkey").alias("id_1"), (F.col("p_partkey") + 1).alias("id_2"))


def _tf(spark: SparkSession, d: str, terms) -> DataFrame:
    return both.counts(_read(spark, d, "part"), "p_partkey", terms(F.col("p_name")))


_CLEAN = "trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"
_WORDS = "list_filter(string_split(" + _CLEAN.format(c="p_name") + ", ' '), lambda x: x <> '')"
_TF = "w AS (SELECT p_partkey, unnest(" + _WORDS + ") AS term FROM part), tf AS (SELECT p_partkey, term, count(*) AS n FROM w GROUP BY ALL)"


@query("t01_clean_text", f"SELECT doc_id, {_CLEAN.format(c='text')} AS cleaned FROM documents")
def clean(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("t02_char_statistics", """
SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS latin,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, len(list_distinct(string_split(text, ''))) AS distinct_chars,
  CASE WHEN length(text) = 0 THEN NULL ELSE round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 9) END AS digit_ratio
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def char_statistics(spark, d):
    t = F.coalesce("text", F.lit(""))
    n, digits = F.char_length(t).cast("long"), text.count_chars(t, "0-9")
    distinct = F.when(n == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.split(t, ""))))
    return _read(spark, d, "documents").select("doc_id", n.alias("n"), text.count_chars(t, "a-zA-Z").alias("latin"), digits.alias("digits"), distinct.cast("long").alias("distinct_chars"), F.round(text.safe_ratio(digits, n), 9).alias("digit_ratio"))


@query("t14_digit_runs", "SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]+'), ' ') AS runs FROM documents")
def digit_runs(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), 0), " ").alias("runs"))


@query("t05_char_ngrams", """
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part),
g AS (SELECT p_partkey, unnest(list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))) AS term FROM s, (VALUES (3), (4), (5)) v(n))
SELECT p_partkey, term, count(*) AS n FROM g GROUP BY ALL""")
def char_ngrams(spark, d):
    return _tf(spark, d, text.char_ngrams)


@query("t20_token_ngrams", f"""
WITH s AS (SELECT p_partkey, {_WORDS} AS w FROM part),
g AS (SELECT p_partkey, unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ''))) AS term FROM s, (VALUES (1), (1), (2), (3), (4)) v(n))
SELECT p_partkey, term, count(*) AS n FROM g GROUP BY ALL""")
def token_ngrams(spark, d):
    return _tf(spark, d, lambda c: text.token_ngrams(text.tokens(c), 1, 4))


@query("a06_frequent_terms", f"WITH {_TF} SELECT term, sum(n)::BIGINT AS n FROM tf GROUP BY term HAVING sum(n) >= 10")
def frequent(spark, d):
    return weights.frequent_terms(_tf(spark, d, text.tokens), 10)


@query("v02_tfidf", f"""
WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5), c AS (SELECT count(DISTINCT p_partkey) AS docs FROM tf)
SELECT p_partkey, term, round(n * (ln((1.0 + docs) / (1.0 + df)) + 1), 6) AS weight FROM tf JOIN df USING (term), c""")
def tfidf(spark, d):
    return weights.tfidf(_tf(spark, d, text.tokens), "p_partkey", 5).withColumn("weight", F.round("weight", 6))


@query("v03_bm25", f"""
WITH {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5), c AS (SELECT count(DISTINCT p_partkey) AS docs FROM tf),
k AS (SELECT * FROM tf JOIN df USING (term)), s AS (SELECT p_partkey, sum(n)::DOUBLE AS size FROM k GROUP BY 1), m AS (SELECT sum(size) / max(docs) AS mean FROM s, c)
SELECT p_partkey, term, round(n * 3.0 / (n + 2.0 * (0.25 + 0.75 * size / mean)) * ln((docs - df + 0.5) / (df + 0.5)), 6) AS weight
FROM k JOIN s USING (p_partkey), c, m""")
def bm25(spark, d):
    return weights.bm25(_tf(spark, d, text.tokens), "p_partkey", min_df=5).withColumn("weight", F.round("weight", 6))


@query("j03_pair_features", f"""
WITH i AS (SELECT *, {_WORDS} AS w FROM part)
SELECT p.p_partkey AS id_1, p.p_partkey + 1 AS id_2, round(abs(a.p_retailprice - b.p_retailprice), 4) AS price_diff, abs(a.p_size - b.p_size) AS size_diff,
  CASE WHEN a.p_brand IS NULL AND b.p_brand IS NULL THEN NULL ELSE coalesce(a.p_brand = b.p_brand, false) END AS same_brand,
  CASE WHEN b.w IS NULL THEN NULL ELSE round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(a.w || b.w)), 1), 9) END AS jaccard
FROM part p LEFT JOIN i a ON a.p_partkey = p.p_partkey LEFT JOIN i b ON b.p_partkey = p.p_partkey + 1""")
def pair_features(spark, d):
    items = _read(spark, d, "part").withColumn("w", text.tokens(F.col("p_name")))
    c = F.col
    return both.with_both(_pairs(spark, d), items, "p_partkey").select(
        "id_1", "id_2", F.round(F.abs(c("p_retailprice_1") - c("p_retailprice_2")), 4).alias("price_diff"), F.abs(c("p_size_1") - c("p_size_2")).alias("size_diff"),
        similarity.null_aware_equal(c("p_brand_1"), c("p_brand_2")).alias("same_brand"),
        F.when(c("w_2").isNotNull(), F.round(similarity.jaccard(c("w_1"), c("w_2")), 9)).alias("jaccard"))


FLAGSHIP = pair_features


@query("d03_chargram_cosine", """
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part),
g AS (SELECT p_partkey, unnest(list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))) AS term FROM s, (VALUES (3), (4), (5)) v(n)),
tf AS (SELECT p_partkey, term, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT p_partkey, sum(n * n)::DOUBLE AS norm FROM tf GROUP BY 1),
dot AS (SELECT a.p_partkey AS id_1, sum(a.n * b.n)::DOUBLE AS dot FROM tf a JOIN tf b ON b.p_partkey = a.p_partkey + 1 AND a.term = b.term GROUP BY 1)
SELECT p.p_partkey AS id_1, p.p_partkey + 1 AS id_2, round(coalesce(dot / sqrt(x.norm * y.norm), 0.0), 9) AS cosine
FROM part p LEFT JOIN dot ON id_1 = p.p_partkey LEFT JOIN m x ON x.p_partkey = p.p_partkey LEFT JOIN m y ON y.p_partkey = p.p_partkey + 1""")
def chargram_cosine(spark, d):
    return both.cosine(_pairs(spark, d), _tf(spark, d, text.char_ngrams), "p_partkey").withColumn("cosine", F.round("cosine", 9))


@query("u04_symmetric_difference", f"""
WITH i AS (SELECT p_partkey, {_WORDS} AS w FROM part)
SELECT a.p_partkey AS id_1, array_to_string(list_sort(list_distinct(list_filter(a.w, lambda x: NOT list_contains(b.w, x)) || list_filter(b.w, lambda x: NOT list_contains(a.w, x)))), ' ') AS differing
FROM i a JOIN i b ON b.p_partkey = a.p_partkey + 1""")
def differing_tokens(spark, d):
    items = _read(spark, d, "part").select("p_partkey", text.tokens(F.col("p_name")).alias("w"))
    out = both.with_both(_pairs(spark, d), items, "p_partkey").where("w_2 is not null")
    return out.select("id_1", F.array_join(F.array_sort(similarity.symmetric_difference(F.col("w_1"), F.col("w_2"))), " ").alias("differing"))


@query("a01_summaries", """
WITH v AS (SELECT l_suppkey, l_quantity AS x, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS mu FROM lineitem)
SELECT l_suppkey, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max, round(stddev_pop(x), 6) AS std,
  CASE WHEN stddev_pop(x) = 0 THEN 0.0 ELSE round(avg(power(x - mu, 3)) / power(stddev_pop(x), 3), 6) END AS skew,
  CASE WHEN stddev_pop(x) = 0 THEN -3.0 ELSE round(avg(power(x - mu, 4)) / power(stddev_pop(x), 4) - 3, 6) END AS kurtosis
FROM v GROUP BY l_suppkey""")
def summaries(spark, d):
    out = stats.summaries(_read(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"))
    return out.select("l_suppkey", *[F.col(c) if c in ("min", "max") else F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("p13_clip_and_scale", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer),
c AS (SELECT c_custkey, least(greatest(c_acctbal, lo), hi) AS x FROM customer, q)
SELECT c_custkey, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS c_acctbal FROM c""")
def clip_and_scale(spark, d):
    return stats.clip_and_scale(_read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("j08_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_yet_done(spark, d):
    urgent = _read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return _read(spark, d, "customer").select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("u02_common_vocabulary", f"WITH {_TF} SELECT term FROM tf WHERE p_partkey % 2 = 0 INTERSECT SELECT term FROM tf WHERE p_partkey % 2 = 1")
def common_vocabulary(spark, d):
    tf = _tf(spark, d, text.tokens)
    return tf.where("p_partkey % 2 = 0").select("term").intersect(tf.where("p_partkey % 2 = 1").select("term"))


@query("i08_equal_bits", "SELECT o_orderkey, 64 - bit_count(xor(o_orderkey, o_custkey))::INT AS same FROM orders")
def equal_bits(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", similarity.equal_bits(F.col("o_orderkey"), F.col("o_custkey")).alias("same"))
