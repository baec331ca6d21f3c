"""Queries on sentences, token classes and spelling rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps, text, tokens
from .catalog import _CLEAN, _read, query

_LETTER = "({0} BETWEEN 'a' AND 'z' OR {0} BETWEEN 'а' AND 'я')"
_ALONE = f"(c[i] = '.' AND i > 1 AND {_LETTER.format('c[i - 1]')} AND ((c[i + 2] = '.' AND {_LETTER.format('c[i + 1]')}) OR (i > 3 AND c[i - 2] = '.' AND {_LETTER.format('c[i - 3]')})))"
_SHORT = f"'([^а-я])({'|'.join(tokens.SHORTENED)})[.]', '\\1\\2 ', 'g'"


def _sentences_sql(text: str, table: str = "documents", key: str = "doc_id") -> str:
    """Common tables that end with z (key, s: the list of sentences). The dots of a run of
    single letters are found by position; a shortened word that follows another one's dot
    is replaced in the second of two passes."""
    low = f"regexp_replace(replace(replace(lower(coalesce({text}, '')), 'ё', 'е'), '²', '2'), '([0-9]+)\\.([0-9]+)', '\\1,\\2', 'g')"
    dotless = f"CASE WHEN t LIKE '%.%' THEN array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN coalesce({_ALONE}, false) THEN '' ELSE c[i] END), '') ELSE t END"
    return f"""l AS (SELECT {key}, {low} AS t, string_split({low}, '') AS c FROM {table}),
f AS (SELECT {key}, regexp_replace(regexp_replace({dotless}, {_SHORT}), {_SHORT}) AS f FROM l),
z AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(f, '[.!?;\\n]'), lambda s: {_CLEAN.format(c='s')}), lambda s: s <> '') AS s FROM f)"""


@query("t09_sentences", f"WITH {_sentences_sql('text')} SELECT doc_id, len(s)::BIGINT AS n, array_to_string(s, '|') AS sentences FROM z")
def sentences(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", tokens.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences"))


_CLASSES = """len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]+')))::BIGINT AS latin,
  len(list_filter(w, lambda x: regexp_full_match(x, '[a-z0-9]+') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')))::BIGINT AS latin_digits,
  len(list_filter(w, lambda x: regexp_full_match(x, '[а-я0-9]+') AND regexp_matches(x, '[а-я]') AND regexp_matches(x, '[0-9]')))::BIGINT AS cyrillic_digits,
  len(list_filter(w, lambda x: regexp_matches(x, '[а-я]') AND regexp_matches(x, '[a-z]')))::BIGINT AS mixed"""


@query("t12_token_classes", f"""
WITH {_sentences_sql('text')}, v AS (SELECT doc_id, list_filter(string_split(array_to_string(s, ' '), ' '), lambda x: x <> '') AS w FROM z)
SELECT doc_id, {_CLASSES} FROM v""")
def token_classes(spark, d):
    return _read(spark, d, "documents").select("doc_id", tokens.class_counts(F.col("text")).alias("n")).select("doc_id", "n.*")


# Texts in which some Latin letters are their Cyrillic look-alikes, or letters of their own,
# as the documents have none: the same replacement in both engines.
_ALIKE_LATIN, _ALIKE_CYRILLIC = "aeo", "аео"
_OWN_LATIN, _OWN_CYRILLIC = "bdgijklmnstuvwyz", "бдгийклмнстуввыз"


@query("t10_repaired_words", f"""
WITH d AS (SELECT doc_id, translate(text, CASE WHEN doc_id % 3 = 0 THEN '{_ALIKE_LATIN}' ELSE '{_OWN_LATIN}' END, CASE WHEN doc_id % 3 = 0 THEN '{_ALIKE_CYRILLIC}' ELSE '{_OWN_CYRILLIC}' END) AS x FROM documents),
{_sentences_sql('x', 'd')},
v AS (SELECT doc_id, unnest(list_filter(string_split(array_to_string(s, ' '), ' '), lambda x: x <> '')) AS w FROM z),
n AS (SELECT *, length(regexp_replace(w, '[^a-z]', '', 'g')) AS en, length(regexp_replace(w, '[^а-я]', '', 'g')) AS ru,
  translate(w, '{"".join(text.LOOK_ALIKES)}', '{"".join(text.LOOK_ALIKES.values())}') AS to_en, translate(w, '{"".join(text.LOOK_ALIKES.values())}', '{"".join(text.LOOK_ALIKES)}') AS to_ru,
  regexp_matches(w, '[{"".join(text.LOOK_ALIKES.values())}]') AS has_en, regexp_matches(w, '[{"".join(text.LOOK_ALIKES)}]') AS has_ru FROM v),
r AS (SELECT doc_id, en > 0 AND ru > 0 AS mixed, CASE WHEN en = 0 OR ru = 0 THEN w WHEN en > ru THEN to_en WHEN ru > en THEN to_ru WHEN has_en AND NOT has_ru THEN to_ru WHEN has_ru AND NOT has_en THEN to_en ELSE w END AS w FROM n)
SELECT doc_id, w, count(*) AS n, count(*) FILTER (mixed) AS n_mixed FROM r GROUP BY ALL""")
def repaired_words(spark, d):
    x = F.when(F.col("doc_id") % 3 == 0, F.translate("text", _ALIKE_LATIN, _ALIKE_CYRILLIC)).otherwise(F.translate("text", _OWN_LATIN, _OWN_CYRILLIC))
    docs = _read(spark, d, "documents").select("doc_id", x.alias("x")).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # the one shuffle
    words = docs.select("doc_id", F.explode(tokens.sentence_tokens(F.col("x"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    # a document's word is repaired once, and only where it has both alphabets
    mixed = F.col("w").rlike("[a-z]") & F.col("w").rlike("[а-я]")
    found = words.select("doc_id", "w", "n", mixed.alias("mixed"))
    repaired = F.when(F.col("mixed"), F.get(text.repaired(F.array("w")), F.lit(0))).otherwise(F.col("w"))
    return found.select("doc_id", repaired.alias("w"), "n", "mixed").groupBy("doc_id", "w").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("mixed"), F.col("n"))), F.lit(0)).alias("n_mixed"))


_TRANSLIT = "translate(x, '{}', '{}')".format("".join(k for k, v in text.LATIN_OF.items() if v and len(v) == 1), "".join(v for v in text.LATIN_OF.values() if v and len(v) == 1))
for _k, _v in text.LATIN_OF.items():
    if not _v or len(_v) > 1:
        _TRANSLIT = f"replace({_TRANSLIT}, '{_k}', '{_v or ''}')"
_CYRILLICISED = ("abcdefghijklmnopqrstuvwxyz", "абцдёфгхийжклмнопщрстувьыяюэш"[:26])


@query("t19_transliteration", f"WITH d AS (SELECT doc_id, translate(lower(text), '{_CYRILLICISED[0]}', '{_CYRILLICISED[1]}') AS x FROM documents) SELECT doc_id, {_TRANSLIT} AS latin FROM d")
def transliteration(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.transliterate(F.translate(F.lower("text"), *_CYRILLICISED)).alias("latin"))


@query("m06_differences_of_left", """
WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT a.user_id, a.event_type, abs(a.n - coalesce(b.n, 0.0)) AS difference
FROM c a JOIN (SELECT DISTINCT user_id FROM events) w ON w.user_id = a.user_id + 1 LEFT JOIN c b ON b.user_id = w.user_id AND b.event_type = a.event_type""")
def differences_of_left(spark, d):
    n = _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # a handful of types
    other = m.select((F.col("user_id") - 1).alias("user_id"), F.col("m").alias("o"))
    return m.join(other, "user_id").select("user_id", F.explode(maps.difference_of_left(F.col("m"), F.col("o"))).alias("event_type", "difference"))


@query("t15_exotic_characters", """
WITH c AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(coalesce(text, ''), ''), lambda x: unicode(x) > 1105))) AS c FROM documents)
SELECT doc_id, coalesce(array_to_string(c, ''), '') AS characters FROM c""")
def exotic_characters(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.array_join(tokens.exotic_characters(F.col("text")), "").alias("characters"))


_COUNTS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))::DOUBLE AS {n}" for n, p in tokens.RULES.items())


@query("d23_spelling_rules", f"""
WITH r AS (SELECT conv_id, turn, {_COUNTS}, abs(len(regexp_extract_all(coalesce(text, ''), '\\(')) - len(regexp_extract_all(coalesce(text, ''), '\\)')))::DOUBLE AS unpaired_bracket FROM conversations)
SELECT a.conv_id, a.turn, {' + '.join(f'abs(a.{n} - b.{n})' for n in [*tokens.RULES, 'unpaired_bracket'])} AS differences,
  {' + '.join(f'least(a.{n}, b.{n})' for n in [*tokens.RULES, 'unpaired_bracket'])} AS common
FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def spelling_rules(spark, d):
    """Mistakes of each turn against those of the next one."""
    m = _read(spark, d, "conversations").select("conv_id", "turn", tokens.mistakes(F.col("text")).alias("m"))
    other = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("m").alias("o"))
    a, b = F.col("m"), F.col("o")
    return m.join(other, ["conv_id", "turn"]).select("conv_id", "turn", maps.total(maps.difference(a, b)).alias("differences"), maps.total(maps.common_min(a, b)).alias("common"))
