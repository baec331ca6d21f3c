import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from test_exact_line_shard_mix import brute_lines, water_fill
from test_jaccard import brute
from twinlens.llm import catalog, pieces, quality

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [None, "", " ", "a  b", "x\ny\r\n", "漢字かな \U0001f600\U0001f600 \t ok", "x" * 700, "Hello   world ", "é ́ß\x00", "    return x", "don't STOP", "ﷺ ... !!!"]


def rows(df):
    return [r.asDict() for r in df.collect()]


def message(fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def as_unigram(data):
    """The same pieces and scores as a unigram model."""
    def trainer(v):
        kept = []
        for k, x in pieces._fields(v):
            if k == 3:
                kept.append((3, 1))
            elif isinstance(x, int) or k in (1, 2, 4, 5, 7, 44):
                kept.append((k, x))
        return message([f for f in kept if isinstance(f[1], int)])

    return message([(k, trainer(v) if k == 2 else v) for k, v in pieces._fields(data) if k in (1, 2, 3)])


@pytest.fixture(scope="module")
def model_bytes():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def texts(awkward, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    return TEXTS + [r["text"] for r in awkward.collect()] + [r["text"] for r in docs.collect()]


def test_bpe_ids_are_those_of_the_library(model_bytes, texts):
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    model = pieces.PieceModel.parse(model_bytes)
    assert model.kind == pieces.BPE
    ids, n = model.encode([t or "" for t in texts])
    ends = np.r_[0, np.cumsum(n)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode([t or "" for t in texts])
    assert model.decode(ids, n) == [(t or "").encode() for t in texts]


def test_unigram_paths_score_as_the_best_of_the_librarys_lattice(model_bytes, texts):
    """The same pieces read as a unigram model. The library's one-best encoder adds
    32-bit scores, and one piece here has -1e9, which drowns the others: its lattice is asked."""
    data = as_unigram(model_bytes)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceModel.parse(data)
    assert model.kind == pieces.UNIGRAM
    parts = [x for t in texts for x in re.findall("[ -~éß]{1,40}", t or "")][:1500]
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for x in parts:
        ids, n = model.encode([x])
        mine, its = score(ids.tolist()), score(library.nbest_encode_as_ids(x, 1)[0])
        assert mine == its if its > -1e8 else mine >= its, x
        assert model.decode(ids, n) == [x.encode()]


def test_little_memory_changes_nothing(model_bytes, texts, monkeypatch):
    whole = pieces.PieceModel.parse(model_bytes).encode([t or "" for t in texts])[0]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    model = pieces.PieceModel.parse(model_bytes)
    assert np.concatenate([model.encode([t or ""])[0] for t in texts]).tolist() == whole.tolist()


def test_encode_decode_frames_and_op1(spark, awkward, nothing, table, model_bytes):
    coded = pieces.encode(awkward)
    assert coded.columns == [c for c in awkward.columns if c != "text"] + ["ids"]
    want = {r["doc_id"]: r["text"] or "" for r in rows(awkward)}
    assert {r["doc_id"]: r["text"] for r in rows(pieces.decode(coded))} == want
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    got = rows(pieces.op1_sentencepiece(spark, table(documents=awkward)))
    for r in got:
        ids = library.encode(want[r["doc_id"]])
        assert (r["n_pieces"], r["ids_sha256"], r["round_trip"]) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)
    assert len(got) == len(want) and pieces.encode(nothing).count() == 0


def test_models_without_support_are_refused(model_bytes):
    with pytest.raises(ValueError):
        pieces.PieceModel.parse(message([(k, v) for k, v in pieces._fields(model_bytes) if k == 1][:100]))


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], folder).cache())
    start, good, lines, near, mix, ids = [rows(f) for f in frames]
    assert [f.columns for f in frames[:-1]] == [docs.columns] * 5 and len(names) == 5
    by = lambda rs: {r["doc_id"]: r["text"] for r in rs}
    scored = {r["doc_id"] for r in rows(quality.score(docs.select("doc_id", "text")).where("_kept"))}
    assert by(good) == {d: t for d, t in by(start).items() if d in scored}
    want = brute_lines(by(good))
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in by(lines).items()} == {d: w[2] for d, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    assert set(by(near)) == {d for d, w in brute(by(lines), 5, 80).items() if w[1] == d}
    sizes, taken = {}, {}
    for r in near:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    for r in mix:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    for s, target in water_fill(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 0.05 * target + max(len((r["text"] or "").split()) for r in near)
    assert sorted(r["doc_id"] for r in ids) == sorted(r["doc_id"] for r in mix)
    assert sorted((r["doc_id"], r["n_pieces"], tuple(r["ids"])) for r in rows(corpus_pipeline.run(spark, folder))) == sorted((r["doc_id"], r["n_pieces"], tuple(r["ids"])) for r in ids)


def test_pipeline_with_awkward_and_no_rows(spark, awkward, repeated, nothing):
    for docs in (repeated, nothing):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.count()


def test_queries_have_the_numbers_one_to_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
