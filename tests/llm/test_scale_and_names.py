"""Long texts, hot groups, clashing names, reruns and what is left in the shared folder."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_exact_line_shard_mix import brute_lines, sha
from test_jaccard import brute, brute_pairs
from test_suffix import brute as brute_spans
from twinlens.llm import _common, chat, exact_dedup, jaccard, line_dedup, mixing, pieces, quality, sharding, suffix, warc


def rows(df):
    return [r.asDict() for r in df.collect()]


def long_text(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choices(["alpha", "béta", "x", "漢字", "end.\n", "  ", "y" * 50], k=n))


def test_long_texts_are_hashed_in_pieces_alike(monkeypatch):
    text = long_text(4000) + "z" * 9000
    whole = quality.text_features(pa.array([text, "a b"]))
    off, data = np.array([0, len(text.encode())]), np.frombuffer(text.encode(), np.uint8)
    words = _common.words(off, data)
    sets = jaccard.shingles(off, data, 3)
    monkeypatch.setattr(_common, "_CHUNK", 512)
    monkeypatch.setattr(_common, "_powers", {})
    monkeypatch.setattr(quality, "_CHUNK", 512)
    again = quality.text_features(pa.array([text, "a b"]))
    assert all(whole[k].tolist() == again[k].tolist() for k in quality.FEATURES)
    assert all((x == y).all() for x, y in zip(words, _common.words(off, data)))
    assert all((x == y).all() for x, y in zip(sets, jaccard.shingles(off, data, 3)))


def test_long_texts_are_encoded_in_parts_alike():
    model = pieces.PieceModel.load(pieces.default_model())
    texts = [long_text(3000, k) + "▁ ▁" + " " * 40 + "q" * 300 for k in range(2)] + [None, "", "short"]
    ids, n = model.encode([t or "" for t in texts])
    parts = list(pieces._encoded(pa.array(texts), model, 700))
    assert np.concatenate([p[2] for p in parts]).tolist() == ids.tolist()
    assert np.concatenate([p[3] for p in parts]).tolist() == n.tolist()


def test_strings_of_long_texts_are_compared_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_CHUNK", 300)
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdef ", k=900))
    texts = {d: "".join(rng.choices("uvw", k=200 + 31 * d)) + passage[40 * d : 500 + 40 * d] + "".join(rng.choices("xyz", k=900)) for d in range(8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    batches = [b for b in suffix._entries(50)(iter([pa.RecordBatch.from_pydict({"doc": [0], "text": [texts[7]]})]))]
    assert len(batches) > 3
    cut = suffix.remove_spans(df, suffix.repeated_spans(df, match=50, n_batches=3))
    assert {r["doc_id"]: sha_bytes(r["_kept"]) for r in rows(cut)} == {d: w[3] for d, w in brute_spans(texts, 50).items()}


def sha_bytes(b):
    import hashlib

    return hashlib.sha256(b).hexdigest()


def test_levels_merge(spark):
    family = suffix.SuffixFamily()
    for k in range(8):
        batch = spark.createDataFrame([(k * 10 + i, f"{'shared passage ' * 9}{'abcdefgh' * 20}{k}{i}" * 2) for i in range(6)], "doc long, text string")
        family.add(batch.mapInArrow(suffix._entries(100), suffix._ENTRY_DDL))
    assert family.merges == 7 and [len(level) for level in family.levels] == [0, 0, 0, 1]
    run = rows(family.arrays()[0])
    assert len({(r["owner"], r["print"]) for r in run}) == len(run)


def test_a_rerun_of_sharding_agrees(spark, table, awkward):
    folder = table(documents=awkward)
    once = sorted(map(str, rows(sharding.op2_sharding(spark, folder))))
    assert all(once == sorted(map(str, rows(sharding.op2_sharding(spark, folder)))) for _ in range(2))
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    dealt = sharding.shuffle_shards(hot, "k", 3, bucket_bytes=4096).cache()
    assert dealt.select("shard").distinct().count() == 1
    assert sorted(r["slot"] for r in rows(dealt)) == list(range(3000))
    with pytest.raises(ValueError):
        sharding.shuffle_shards(hot.withColumnRenamed("v", "Slot"), "k", 3)


def test_hot_texts_are_thinned(spark):
    texts = [(i, "hot" if i % 3 else f"text {i % 50}") for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(20)
    got = rows(exact_dedup.exact_dedup(df, bucket_bytes=8))
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    assert {r["doc_id"]: (r["keep_id"], r["kept"], r["text_sha256"]) for r in got} == {i: (first[t], first[t] == i, sha(t)) for i, t in texts}


def test_large_leaves_are_packed_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng, base = random.Random(9), [f"b{i}" for i in range(200)]
    texts = {}
    for k in range(70):  # about one document, of sizes that differ; some are near the hub only by others
        words = base[: 200 - k % 30] + [f"e{rng.randrange(9)}" for _ in range(k % 7)]
        texts[3 + k] = " ".join(words[k % 5 :])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts, 1, 90)
    kept = {r["doc_id"] for r in rows(jaccard.keep_one(df, n_words=1, percent=90))}
    assert kept == {d for d, w in want.items() if w[1] == d} and len(kept) < 40
    _, links = jaccard.jaccard_classes(df, n_words=1, percent=90)
    assert sorted((r["a"], r["b"]) for r in rows(links)) == sorted(brute_pairs(texts, 1, 90)[1])


def test_large_documents_do_not_spoil_the_mix(spark):
    rng = random.Random(4)
    docs = [(i, "w " * (4000 if i % 40 == 0 else rng.randint(1, 60)), f"s{i % 8}") for i in range(1600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mixed = rows(mixing.mix_sources(df, seed=1).drop("text"))
    taken, target, largest = {}, {}, {}
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + r["_copies"] * r["_size"]
        target[r["source"]] = r["_target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["_size"])
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 70) for s in target if largest[s] < 4000)
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
    assert all(r["_copies"] <= 2 for r in mixed)


def turns_of(n, step=1):
    return [(1, 5 + step * i, "system" if i == 0 else ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i % 17)) for i in range(n)] + [(2, 0, "user", "x"), (None, 3, "assistant", "y")]


@pytest.mark.parametrize("step", [1, 1000])
def test_long_conversations_are_dealt_in_ranges(spark, monkeypatch, step):
    monkeypatch.setattr(chat, "RANGE", 32)
    turns = turns_of(300, step)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.format_conversations(df, budget=120, history_tokens=40, history_turns=3)
    got = sorted(rows(windows.where("conv_id = 1")), key=lambda r: r["window"])
    assert len({r["window"] >> 32 for r in got}) > 3
    later = [r for r in got if r["window"] >> 32]
    assert all(r["formatted"].startswith("<|im_start|>system\n") and r["n_repeated"] >= 1 for r in later)
    assert sum(r["n_repeated"] > 1 for r in later) > len(later) / 2
    back = {r["conv_id"]: r for r in rows(chat.read_formatted(windows))}
    assert [(x["role"], x["text"]) for x in back[1]["turns"]] == [(r, t) for c, _, r, t in turns if c == 1]
    assert back[1]["loss_text"] == "".join(t for c, _, r, t in turns if c == 1 and r == "assistant")
    assert set(back) == {1, 2, None}


def test_null_ids_lose_lines_by_themselves(spark):
    line = "the same long line of more than forty characters"
    docs = [(None, f"{line}\nn{i}") for i in range(6)] + [(i, f"{line}\nd{i}") for i in range(4)]
    got = rows(line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")))
    assert sorted(r["text"] for r in got) == sorted([f"n{i}" for i in range(6)] + [f"d{i}" for i in range(3)] + [f"{line}\nd3"])


CLASHES = ["_f", "_pattern", "pattern", "posterior", "_id", "_drop", "_lines", "_kept", "_spans", "spans", "_text", "ids", "_gone", "n_lines", "_row", "_at", "_size", "class_id", "source", "_class", "place", "rank"]


def test_names_may_clash(spark, awkward):
    slim = awkward.select("doc_id", "text").where("doc_id < 200")
    odd = slim.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    texts = {r["doc_id"]: r["text"] for r in rows(slim)}

    def same(got, gone=()):
        got = rows(got)
        assert got and all(r[c] == f"own {c}" for r in got for c in CLASHES if c not in gone)
        return {r["doc_id"]: r for r in got}

    assert set(same(quality.keep_good(odd))) == {r["doc_id"] for r in rows(quality.keep_good(slim))}
    assert len(same(quality.score(odd), ("_f", "_kept"))) == len(texts)
    lines = same(line_dedup.line_dedup(odd), ("n_lines",))
    assert {d: (r["n_lines"], r["n_dropped"], sha(r["text"] or "")) for d, r in lines.items()} == brute_lines(texts)
    spans = suffix.repeated_spans(odd, n_batches=2)
    cut = same(suffix.remove_spans(odd, spans), ("_kept", "_spans"))
    assert {d: sha_bytes(r["_kept"]) for d, r in cut.items()} == {d: w[3] for d, w in brute_spans(texts).items()}
    assert set(same(jaccard.keep_one(odd, n_words=3, percent=90))) == {d for d, w in brute(texts, 3, 90).items() if w[1] == d}
    mixed = same(mixing.mix_sources(odd), ("_size",))
    assert len(mixed) == len(texts)
    coded = pieces.encode(odd)
    back = same(pieces.decode(coded), ("ids",))
    assert {d: r["text"] for d, r in back.items()} == {d: t or "" for d, t in texts.items()}


def test_plain_arcs_and_rolled_files(spark, tmp_path, monkeypatch):
    head = b"filedesc://x 0.0.0.0 20200101000000 text/plain 15\n1 0 y\nfields\n\n\n"
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n" + b"p" * 120
    record = b"http://a 0.0.0.0 20200102030405 text/html %d\n" % len(body) + body + b"\n"
    os.makedirs(tmp_path / "arc")
    (tmp_path / "arc" / "a.arc").write_bytes(head + record + record)
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    got = rows(warc.read_arc(spark, arc))
    assert [(r["page_id"], r["n"], warc.arc_body(r["member"], r["length"])) for r in got] == [(7, 120, body)] * 2
    warc.convert(spark, arc, out)
    assert sorted(r["type"] for r in rows(warc.read_warc(spark, out))) == ["response", "revisit"]
    with pytest.raises(ValueError, match="length"):
        list(warc.parse_arc(head + b"no length here\n"))

    class Task:
        @staticmethod
        def get():
            return Task

        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(warc, "TaskContext", Task)
    monkeypatch.setattr(warc, "ROLL_BYTES", 200)
    f = warc._File(f"file://{tmp_path}/rolled", "", ".warc.gz", lambda name: name.encode())
    for k in range(9):
        f.add(os.urandom(90))
    f.close()
    assert len(os.listdir(tmp_path / "rolled")) > 2 and all(x.startswith("000003-") for x in os.listdir(tmp_path / "rolled"))


def test_only_what_results_read_is_left(spark, awkward, monkeypatch):
    made = []
    new_path = _common.new_path
    monkeypatch.setattr(_common, "new_path", lambda s, name: made.append(new_path(s, name)) or made[-1])
    docs, before = awkward.select("doc_id", "text"), {t.name for t in spark.catalog.listTables()}
    left = lambda: {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in made if os.path.exists(p.removeprefix("file:"))}
    suffix.repeated_spans(docs).count()
    assert left() == {"suffix-spans"}
    line_dedup.line_dedup(docs).count()
    assert left() == {"suffix-spans", "line-occurrences", "line-frequent"}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_pipeline_leaves_its_last_input_only(awkward, spark, table):
    import os

    import corpus_pipeline

    folder = _common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = awkward.select("doc_id", "text", "lang", F.coalesce("source", F.lit("s")).alias("source"), "n_chars")
    sf_dir = table(documents=docs, labels=spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    want = corpus_pipeline.run(spark, sf_dir).count()
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if not x.startswith("."))
    assert left == ["pipeline-mixing"]
    # stage by stage without writing between: nothing that is still read goes
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    assert out.count() == want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        _common.shared_dir(Session)
