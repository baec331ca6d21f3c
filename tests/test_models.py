import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.functions import text
from twinlens.operators import blocks, latent, learning
from twinlens.plans import catalog, models  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_singular_vectors_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(30)] + ["", None, "once"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    k = 4
    got = {r["id"]: np.array(r["latent"]) for r in latent.singular_vectors(items, "id", text.tokens(F.col("text")), k, min_df=2).collect()}
    tf = np.array([[(t or "").split().count(w) for w in words] for t in texts], float)
    x = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:k].T
    have = np.array([got[i] for i in range(len(texts))])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-8)  # a singular vector's sign is free
    assert np.allclose(have @ have.T, want @ want.T)
    assert not have[-3:].any()  # empty, null, no known word


def test_more_components_than_words(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b b")], "id long, text string")
    rows = latent.singular_vectors(items, "id", text.tokens(F.col("text")), 10, min_df=1).collect()
    assert [len(r["latent"]) for r in rows] == [2, 2, 2]


def test_many_vectors_in_stripes_and_salts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.random((120, 80)) < 0.2) * rng.random((120, 80)) * np.geomspace(9, 0.1, 80)
    rows = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    entries = spark.createDataFrame(rows, "id long, term string, value double").repartition(5)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "STREAMED", 40)
    v, values = blocks.right_singular_vectors(entries, "id", "term", "value", 6, more=20, rounds=2)
    want = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, want[1][:6], rtol=1e-4)
    got = {r.key: r.vector for r in v.collect()}
    have = np.array([got[f"t{j}"] for j in range(80)])
    assert np.allclose(np.abs(np.sum(have * want[2][:6].T, 0)), 1, atol=1e-2) and np.allclose(have.T @ have, np.eye(6), atol=1e-8)


def test_products_of_many_entries_are_dealt_in_many_tasks():
    # the words of 0.1 GB of documents: one task streamed them all
    stripes, salts = blocks.dealt_in(10_000_000, 50_000, 140)
    assert stripes * salts >= 5
    # copies of the dense side follow the entries
    for more in (1, 6, 60):
        stripes, salts = blocks.dealt_in(more * 10_000_000, more * 50_000, 140)
        assert salts * more * 50_000 * 140 * 8 <= 2 * 64 * more * 10_000_000 + (1 << 26)


def test_products_look_up_columns_of_many_rows_at_once(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = (rng.random((90, 40)) < 0.4) * rng.random((90, 40))
    entries = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id long, term string, value double").repartition(3)
    t = rng.random((40, 3))
    table = spark.createDataFrame([(f"t{j}", [float(v) for v in t[j]]) for j in range(40)], "key string, vector array<double>")
    for looked_up, streamed in ((7, 1 << 21), (1 << 17, 1 << 21), (50, 100)):
        monkeypatch.setattr(blocks, "LOOKED_UP", looked_up)
        monkeypatch.setattr(blocks, "STREAMED", streamed)
        got = {r.key: r.vector for r in blocks.product(entries, "id", "term", "value", table, 3, entries.count(), 40).collect()}
        assert np.allclose([got[i] for i in sorted(got)], (x @ t)[sorted(got)]) and len(got) == (x.any(1)).sum()


def test_dense_matches(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0])], "id long, v array<double>")
    pairs = spark.createDataFrame([(1, 3), (1, 2)], "id_1 long, id_2 long")
    got = {(r["id_1"], r["id_2"]): list(r)[2:] for r in latent.dense_matches(pairs, rows, "id", "v", first=1).collect()}
    assert got[1, 3] == pytest.approx([24.0, 2.0, 2.0, 0.96, 1.0])
    assert got[1, 2] == [0.0, 25.0, 7.0, 0.0, 3.0]


def test_word_vectors_bring_words_of_one_context_together(spark):
    rng = np.random.default_rng(5)
    contexts = {"red": "paint wall colour brush".split(), "blue": "paint wall colour brush".split(), "seven": "count add sum odd".split()}
    rows = []
    for i in range(1200):
        w = list(contexts)[i % 3]
        rows.append(([str(x) for x in rng.permutation([w, *rng.choice(contexts[w], 3)])],))
    sentences = spark.createDataFrame(rows, "words array<string>")
    table = latent.word_vectors(sentences, "words", size=16, least=5, parts=1, rounds=5).cache()
    v = {r["term"]: np.array(r["vector"]) for r in table.collect()}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert set(v) == {"red", "blue", "seven", *sum(contexts.values(), [])}
    assert cos("red", "blue") > cos("red", "seven") + 0.1

    items = spark.createDataFrame([(1, "red red wall"), (2, "none known"), (3, None)], "id long, text string")
    got = {r["id"]: np.array(r["sentence"]) for r in latent.summed_vectors(items, "id", text.tokens(F.col("text")), table, 16).collect()}
    want = 2 * v["red"] + v["wall"]
    assert np.allclose(got[1], want / np.linalg.norm(want))
    assert not got[2].any() and not got[3].any()


def test_null_components_agree_with_numpy(spark):
    rng = np.random.default_rng(7)
    hidden = rng.random((200, 3)) < [0.5, 0.3, 0.1]
    hidden[:, 1] |= hidden[:, 0]
    rows = [(i, *[None if h else 1.0 for h in hs]) for i, hs in enumerate(hidden)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = np.array([r["null_components"] for r in latent.null_components(df, ["a", "b", "c"], 2).orderBy("id").collect()])
    x = hidden.astype(float)
    want = x @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_signed_terms_are_the_planted_ones(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        label = i % 2
        own = ["fine" if label else "awful"] if rng.random() < 0.8 else []
        rows.append((i, [*own, *rng.choice(["and", "the", "of"], 2).tolist()], float(label)))
    df = spark.createDataFrame(rows, "id long, words array<string>, label double")
    terms = learning.signed_terms(df, "id", F.col("words"), "label", c=0.3, rounds=16)
    signs = {r["term"]: r["coefficient"] > 0 for r in terms.collect()}
    assert signs["fine"] and not signs["awful"] and "rare" not in signs
    items = spark.createDataFrame([(1, ["fine", "fine", "awful"]), (2, ["x"]), (3, None)], "id long, words array<string>")
    kept = terms.where(F.col("term").isin("fine", "awful"))
    assert sorted(map(tuple, learning.signed_counts(items, "id", F.col("words"), kept).collect())) == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_scores_of_components_are_of_use_on_unseen_rows(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(400):
        x = rng.normal()
        rows.append((i, x + rng.normal() / 5, x + rng.normal() / 5, None if i % 9 == 0 else x, float(x > 0)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double").withColumn("fold", learning.fold("id"))
    scored = learning.component_scores(df, "id", ["a", "b", "c"], 1, c=0.1, rounds=12)
    assert scored.count() == 400 and learning.auc(scored) > 0.95


def test_queries_that_fit_models(spark):
    for name in ("v04_singular_vectors", "v04_attribute_vectors", "v05_word_vectors", "v06_context_vectors"):
        df = catalog.QUERIES[name](spark, SF)
        n = df.count()
        assert n == df.select("id_1", "id_2").distinct().count() > 0
        cosines = [c for c in df.columns if c.endswith("cosine")]
        assert df.where(" or ".join(f"abs({c}) > 1.000001" for c in cosines)).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    for name in ("l04_scores_of_components", "l05_signed_terms"):
        assert catalog.QUERIES[name](spark, SF).count() == labels


def test_word_vectors_are_trained_on_all_cores_from_stored_lines(spark, monkeypatch):
    made = []

    class Learner(latent.Word2Vec):
        def fit(self, sentences):
            made.append((self.getNumPartitions(), sentences.inputFiles()))
            return super().fit(sentences)

    monkeypatch.setattr(latent, "Word2Vec", Learner)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: 12))
    assert catalog.QUERIES["v05_word_vectors"](spark, SF).columns[:2] == ["id_1", "id_2"]
    parts, files = made[0]
    assert parts == 12 and files and all("/lines-" in f for f in files)


def test_stacked_scores(spark):
    rows = catalog.QUERIES["l10_stacking"](spark, SF).cache()
    assert rows.count() == rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    assert rows.where("score < 0 or score > 1 or trees is null or subspaces is null or linear is null").count() == 0
    best = {n: learning.auc(rows, score=n) for n in ("trees", "subspaces", "score")}
    assert all(a > 0.6 for a in best.values()), best


def test_random_subspaces_find_the_group_that_tells(spark):
    rng = np.random.default_rng(17)
    rows = [(i, float(i % 2), i % 3, float(i % 2) + rng.normal() / 4, rng.normal(), None if i % 5 == 0 else rng.normal()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label double, fold int, a double, b double, c double")
    out = learning.subspace_scores(df, "id", {"x": ["a"], "y": ["b", "c"]}, lambda rng: learning.boosted(rounds=2, rng=rng), runs=2, drawn=2)
    assert out.count() == 240 and learning.auc(out) > 0.95


@pytest.mark.parametrize("size", [1 << 19, 60])
def test_singular_vectors_deal_the_matrix_once(spark, monkeypatch, size):
    def again(*_, **__):
        raise AssertionError("entries are dealt anew")

    monkeypatch.setattr(blocks, "product", again)
    monkeypatch.setattr(blocks, "PACKED", size)
    rng = np.random.default_rng(23)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 12)) * (rng.random((40, 12)) < 0.7)
    entries = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id long, term string, value double")
    v, s = blocks.right_singular_vectors(entries, "id", "term", "value", 4, more=8, rounds=1)
    _, want, w = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[:4], atol=1e-8)
    got = {r.key: np.array(r.vector) for r in v.collect()}
    have = np.array([got[f"t{j}"] for j in range(12)])
    assert np.allclose(np.abs(have), np.abs(w[:4].T), atol=1e-6)
