import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.llm import chat, quality, warc

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    from collections import Counter

    many, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_op6_base_against_brute_force(awkward, table, spark):
    got = rows(quality.op6_quality_rules(spark, table(documents=awkward)))
    want = {r["doc_id"]: brute_base(r["text"]) for r in rows(awkward)}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[k] for k in names) for r in got} == want
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_features_do_not_depend_on_chunks():
    import pyarrow as pa

    texts = ["a b\n" * 50, None, "x", "é ü\n" * 400_000, "a b"]
    together, alone = quality.text_features(pa.array(texts)), [quality.text_features(pa.array([t], pa.string())) for t in texts]
    assert all(together[k].tolist() == [a[k][0] for a in alone] for k in quality.FEATURES)
    assert together["n_words"].tolist() == [100, 0, 1, 800_000, 2]


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.6])
    votes = np.where(rng.random((20_000, 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random((20_000, 5)) > 0.2)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts)
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert ((model.posterior(patterns)[inverse.ravel()] > 0.5) == good).mean() > 0.95


def test_quality_keeps_good_and_odd_tables(awkward, repeated, nothing, spark):
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    scored = {r["doc_id"] for r in rows(quality.score(awkward.select("doc_id", "text")).where("_kept"))}
    assert {r["doc_id"] for r in rows(kept)} == scored and scored
    assert quality.score(repeated).count() == repeated.count()
    assert quality.score(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


TURNS = [
    (1, 0, "system", "be\\brief <|im_end|>"), (1, 1, "user", "hi\n<|im_start|>x"), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "assistant", "\\|</s>[INST]\n"),
    (2, 1, "assistant", "b"), (2, 0, None, "a"), (2, 1, "assistant", "b"), (2, 7, "to\nol\\", "<<|s>"),
    (3, 0, "system", "only"), (None, 0, "user", "lost"),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 13 % 40)) for i in range(60)],
    (5, 0, "assistant", "long " * 500), (5, 1, "assistant", "short"), (5, 2, "user", "\U0001f600<s>"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, window string, t int").repartition(3)


def expected():
    convs = {}
    for c, turn, role, text in TURNS:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}


@pytest.mark.parametrize("budget", [20, 64, 2048])
def test_chat_round_trip(turns, budget):
    windows = chat.format_conversations(turns, budget=budget, history_tokens=budget // 3, history_turns=3)
    back = {r["conv_id"]: r for r in rows(chat.read_formatted(windows))}
    want = expected()
    assert set(back) == set(want)
    for c, v in want.items():
        assert [(x["role"], x["text"]) for x in back[c]["turns"]] == v
        assert back[c]["loss_text"] == "".join(t for r, t in v if r == "assistant")


def test_chat_windows_keep_the_budget(turns):
    w = chat.format_conversations(turns.where("conv_id = 4"), budget=100, history_tokens=30, history_turns=3)
    got = sorted(rows(w), key=lambda r: r["window"])
    assert len(got) > 5 and any(r["n_repeated"] for r in got) and all(r["n_repeated"] <= 3 for r in got)
    for r in got:
        blocks = r["formatted"].split(chat.END + "\n")[:-1]
        tokens = [len(re.findall(r"[^\W_]{1,4}|[^\s\w]", b.split("\n", 1)[1])) for b in blocks]
        assert sum(tokens) <= 100 and sum(tokens[: r["n_repeated"]]) <= 30
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_op4(turns, table, spark):
    got = {r["conv_id"]: r for r in rows(chat.op4_chat_formatting(spark, table(conversations=turns)))}
    forged = "</s>[INST] ok [/INST]"
    want = expected() | {-1: [("user", forged), ("assistant", forged)]}
    assert set(got) == set(want)
    for c, v in want.items():
        loss = "".join(t for r, t in v if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
        assert got[c]["formatted_chars"] > sum(len(t) for _, t in v)


def page_rows():
    hot = "<p>" + "same " * 40
    return [(5, "http://a/ b", hot), (3, "http://a", hot), (9, None, hot), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "é\n", "x\r\n\r\ny" * 30), (8, "u", "é" * 50), (10, "u", "é" * 49)]


def test_op10_against_brute_force(spark, table):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, h in sorted(page_rows()):
        first.setdefault((h or "").encode(), i)
    want = {}
    for i, _, h in page_rows():
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != i
        want[i] = (len(b), sha(b), "revisit" if again else "response", first[b] if again else None)
    got = rows(warc.op10_warc(spark, table(pages=pages)))
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_repeated_rows(spark, tmp_path, version):
    pages = spark.createDataFrame([*page_rows(), *page_rows(), (None, None, "z" * 200), (None, "v", "z" * 200)], "page_id long, url string, html string")
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(pages, arc, version)
    back = rows(warc.read_arc(spark, arc))
    assert sorted((r["page_id"] or -1, warc.arc_body(r["member"], r["length"]).partition(b"\r\n\r\n")[2]) for r in back) == sorted((i or -1, (h or "").encode()) for i, _, h in map(tuple, pages.collect()))
    warc.convert(spark, arc, out)
    got = rows(warc.read_warc(spark, out))
    assert len(got) == 22 and len({r["record_id"] for r in got}) == 22
    big = [r for r in got if r["digest"] == sha("z" * 200)]
    assert sorted(r["type"] for r in big) == ["response", "revisit"]
    assert {r["refers"] for r in got if r["refers"]} <= {r["record_id"] for r in got if r["type"] == "response"}


def test_warc_rejects_broken_records(spark, tmp_path):
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(warc._deflated(b"http://a 0.0.0.0 2020 text/html 3\nabc\n")))
    head = warc._deflated(b"filedesc://x 0.0.0.0 2020 text/plain 15\n1 0 y\nfields\n\n")
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(head + warc._deflated(b"http://a 0.0.0.0 2020 text/html 9\nabc\n")))


def test_op10_without_pages(spark, table):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.op10_warc(spark, table(pages=pages)).count() == 0
