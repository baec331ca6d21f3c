import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinlens.functions import contact, maps, parsers, similarity, text, tokens
from twinlens.operators import hashes, learning, stats, vectors, weights
from twinlens.plans import catalog, families, measures, token_queries, vector_queries  # noqa: F401
from twinlens.sources import tables
from twinlens.streaming import items

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_cases(spark):
    assert one(spark, text.clean_text(F.col("s")), s="Ёлка, 2шт!") == "елка 2шт"
    assert one(spark, text.char_ngrams(F.col("s")), s="ab cd") == ["abc", "bcd", "abcd"]
    assert one(spark, text.char_ngrams(F.col("s")), s="ab") == []
    assert one(spark, text.token_ngrams(F.col("s"), 1, 4), s=["1", "2"]) == ["1", "2", "1", "2", "12"]
    assert one(spark, text.transliterate(F.col("s")), s="щ1") == "sh1"


def test_similarity_cases(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        similarity.jaccard(a, b), similarity.jaccard(a, b, 1), similarity.jaccard(none, none), similarity.symmetric_difference(a, b),
        similarity.equal_bits(F.lit(0b1010), F.lit(0b1000)),
        *[similarity.null_aware_equal(x, y) for x, y in ((F.lit(None), F.lit(None)), (F.lit(1), F.lit(None)), (F.lit(1), F.lit(1)))]).first()
    assert list(row) == [pytest.approx(1 / 3), 0.25, 0.0, ["a", "c"], 63, None, False, True]


def test_summary_of_equal_values(spark):
    rows = {r["g"]: r for r in stats.summaries(spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 2.0), (2, 4.0), (2, 9.0)], "g int, x double"), ["g"], F.col("x")).collect()}
    assert (rows[1]["skew"], rows[1]["kurtosis"]) == (0.0, -3.0)
    assert (rows[2]["p25"], round(rows[2]["skew"], 6), round(rows[2]["kurtosis"], 6)) == (1.75, 0.768417, -1.0)


def plain(rows):
    def show(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted([tuple(map(show, r)) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "part", "customer", "orders", "lineitem", "embeddings", "pages", "events", "conversations", "labels", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert plain(got.collect()) == plain(con.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_contact_cases(spark):
    found = contact.contacts(F.col("s"))
    row = spark.createDataFrame([("Пиши: Vasya@Яндекс.ру, a@маил.ру; www.shop.ru/x/ тел 8 (912) 345-67-89 #тег @@код@@ a.b.c.d.com 1.2abc.ru",), (None,)], "s string").select(*[c.alias(n) for n, c in found.items()]).collect()
    assert (row[0]["emails"], row[0]["phones"]) == (["vasya@yandex.ru", "a@mail.ru"], ["+79123456789"])
    assert (row[0]["links"], row[0]["hashtags"], row[0]["placeholders"]) == (["shop.ru/x"], ["#тег"], ["@@код@@"])
    assert all(c == [] for c in row[1])


def test_map_cases(spark):
    pair = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    a, b = pair("x", 1.0, "y", 2.0), pair("y", 5.0, "z", 3.0)
    row = spark.range(1).select(maps.merge_sum(a, b), maps.common_min(a, b), maps.common_min_share(a, b), maps.difference(a, b), maps.squared_distance(a, b), maps.cosine(a, b), maps.pairs_as_tokens(pair("A b", "C"))).first()
    assert list(row) == [{"x": 1.0, "y": 7.0, "z": 3.0}, {"y": 2.0}, {"y": 2 / 6}, {"x": 1.0, "y": 3.0, "z": 3.0}, 19.0, pytest.approx(10 / math.sqrt(5 * 34)), ["a_b=c"]]


def test_vector_cases(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ((1.0, -2.0, 3.0), (2.0, -4.0, 6.0), (0.0, 0.0, 0.0)))
    row = spark.range(1).select(vectors.squared_euclidean(a, b), vectors.manhattan(a, b), vectors.cosine(a, b), vectors.cosine(a, zero), vectors.correlation(a, b), vectors.sign_bits(a), vectors.hamming(F.lit(5), F.lit(3)), vectors.shared_ones(F.lit(5), F.lit(3))).first()
    assert list(row) == pytest.approx([14.0, 6.0, 1.0, 0.0, 1.0, 5, 2, 1])


def test_out_of_fold_scores_are_of_use_on_unseen_rows(spark):
    rows = spark.range(400).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(9)).cast("double")).alias("noise"), ((F.col("id") + F.pmod(F.xxhash64("id"), F.lit(100))) > 250).cast("double").alias("label"))
    out = learning.out_of_fold(rows.withColumn("fold", learning.fold("id")), ["x", "noise"], lambda: learning.stacker(1.0, 300)).cache()
    assert out.select("id").distinct().count() == out.count() == 400
    assert learning.auc(out) > 0.9


def test_stream_of_items(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for n in (1, 2):
        docs.where(F.col("doc_id") % 2 == n - 1).write.mode("append").parquet(str(tmp_path / "in"))
        items.process_new(items.read_new(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_token_cases(spark):
    assert one(spark, tokens.sentences(F.col("s")), s="Цена 3.5 м². Ёж!; ?\nok") == ["цена 3 5 м2", "еж", "ok"]
    words = F.array(*map(F.lit, ("abc", "а1", "b2", "aб", "1")))
    row = spark.range(1).select(tokens.latin_only(words), tokens.cyrillic_with_digits(words), tokens.latin_with_digits(words), tokens.mixed_script(words), tokens.corrected(words, {"1": "one"}), tokens.without(words, ["1", "abc"])).first()
    assert list(row) == [["abc"], ["а1"], ["b2"], ["aб"], ["abc", "а1", "b2", "aб", "one"], ["а1", "b2", "aб"]]
    assert one(spark, tokens.exotic_characters(F.col("s")), s="aя☎☎") == ["☎"]
    assert one(spark, tokens.mistakes(F.col("s")), s="a ,b (c. d") == {"space_before_comma": 1.0, "comma_without_space": 1.0, "lower_case_start": 1.0, "unpaired_bracket": 1.0}


def test_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "p": "{\\"k\\": \\"v\\"}"}\nbroken\n')
    df = tables.read_json_lines(spark, str(tmp_path / "a.json"), spark.createDataFrame([], "id long, p string").schema).cache()
    assert sorted(r["_rejected"] for r in df.collect() if r["_rejected"]) == ["broken"]
    assert tables.with_properties(df, "p").where("id = 1").first()["properties"] == {"k": "v"}
    dim = spark.createDataFrame([(2, "x")], "id long, name string")
    assert tables.with_dimension(spark.createDataFrame([(1,), (2,)], "id long"), dim, "id").orderBy("id").collect() == [(1, "None"), (2, "x")]
    assert tables.not_yet_done(spark.createDataFrame([(1,), (2,)], "id long"), dim, "id").collect() == [(1,)]


def test_dots_of_abbreviations_and_shortened_words(spark):
    assert one(spark, tokens.sentences(F.col("s")), s="т.е. да") == ["те да"]
    assert one(spark, tokens.sentences(F.col("s")), s="5 кг. муки") == ["5 кг муки"]
    assert one(spark, tokens.sentence_tokens(F.col("s")), s="3.5 л") == ["3", "5", "л"]
    assert one(spark, tokens.number_forms(F.col("s")), s="5 кг.мл. к.г") == "5 кг мл  к.г"


def test_words_of_both_alphabets(spark):
    words = ["iрhone", "abc", "мoсква", "ор", "xя", "жw"]
    assert one(spark, text.repaired(F.col("w")), w=words) == ["iphone", "abc", "москва", "ор", "хя", "жw"]
    assert one(spark, tokens.mixed_count(F.col("w")), w=words) == 4
    assert one(spark, text.transliterate(F.col("s")), s="жйыющъ") == "giiysh"


def test_differences_of_the_left_side(spark):
    pair = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    row = spark.range(1).select(maps.difference_of_left(pair("x", 1.0, "y", 2.0), pair("y", 5.0, "z", 3.0)).alias("m")).first()
    assert row["m"] == {"x": 1.0, "y": 3.0}


def test_documents_without_terms_count(spark):
    tf = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", 1.0)], "id int, term string, n double")
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    got = {(r["id"], r["term"]): r["weight"] for r in weights.tfidf(tf, "id", items=items).collect()}
    assert got[2, "a"] == pytest.approx(math.log(5 / 3) + 1)
    got = {(r["id"], r["term"]): r["weight"] for r in weights.bm25(tf, "id", items=items).collect()}
    assert got[2, "b"] == pytest.approx(3 / (1 + 2 * (0.25 + 0.75 * 2 / 1)) * math.log((4 - 1 + 0.5) / 1.5))


def test_hex_hashes_and_parsers(spark):
    assert one(spark, hashes.hex_hamming(F.col("a"), F.col("b")), a="ff" + "0" * 20 + "f", b="0f" + "0" * 21) == 8
    assert one(spark, parsers.report(F.col("s"), "r_"), s='"a"=>"1", x, "b"=>""') == {"r_a": "1", "r_b": "NA"}
    assert one(spark, parsers.file_size(F.col("s")), s="2MB") == 2097152.0
    assert one(spark, families.leading_number(F.col("s")), s="125009-1") == 125009


def test_resources_and_sinks(spark, tmp_path):
    (tmp_path / "fix.txt").write_text("iphone=айфон, ,ифон\nplain line\n")
    fix = tables.read_corrections(spark, str(tmp_path / "fix.txt"))
    assert sorted(map(tuple, fix.collect())) == [("айфон", "iphone"), ("ифон", "iphone")]
    words = spark.createDataFrame([(1, "айфон"), (2, "x")], "id int, term string")
    assert sorted(r["term"] for r in tables.corrected_words(words, fix).collect()) == ["iphone", "x"]
    (tmp_path / "ends.txt").write_text("ru\n\nde\nru\n")
    assert tables.read_lines(spark, str(tmp_path / "ends.txt")) == ["de", "ru"]
    df = spark.createDataFrame([(1, "a\tb", 2.5)], "id long, s string, x double")
    tables.write_keyed_json(df, str(tmp_path / "keyed"), "id")
    (tmp_path / "keyed" / "more.txt").write_text("2\tbroken{\n")
    back = tables.read_keyed_json(spark, str(tmp_path / "keyed"), spark.createDataFrame([], "s string, x double").schema).cache()
    good, broken = tables.split_rejected(back)
    assert [tuple(r) for r in good.collect()] == [("1", "a\tb", 2.5)] and [r["line"] for r in broken.collect()] == ["broken{"]
    for k in (1, 2):
        tables.write_csv(spark.createDataFrame([(k, 0.5)], "id int, score_x double"), str(tmp_path / f"model{k}"), compressed=k == 2)
    parts = tables.read_named_parts(spark, str(tmp_path / "model*"))
    assert parts.count() == 2 and parts.where(F.col("file").endswith(".csv.gz")).count() == 1 and tables.columns_with(parts, "score") == ["score_x"]


def test_random_subspaces_are_seeded():
    import random

    groups = {"a": ["a1", "a2"], "b": ["b1"], "c": ["c1"]}
    draw = lambda: learning.draw_columns(groups, random.Random(3), 2, ("id",), 0.9)
    assert draw() == draw() and draw()[0] == "id"
    assert 0.9 <= learning.jitter(1.0, random.Random(1)) <= 1.1


def test_windowed_counts_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    counted = items.windowed_counts(items.read_new(spark, str(tmp_path / "in"), events.schema), "ts", ["event_type"], "1 day", "1 day")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {(r["d"], r["event_type"]): r["n"] for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("counted").collect()} == want
