import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from twinlens.llm import sharding
from twinlens.llm.exact_dedup import exact_dedup, kept_documents, op5_exact_dedup
from twinlens.llm.line_dedup import line_dedup, op3_line_dedup
from twinlens.llm.mixing import emit_copies, mix_sources, op8_mixing, source_targets
from twinlens.llm.sharding import op2_sharding, shuffle_shards, write_shards

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WS = " \t\n\x0b\x0c\r"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_op5_against_brute_force(awkward, table, spark):
    texts = {r["doc_id"]: re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in rows(awkward)}
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    want = {d: (min(groups[t]), len(groups[t]), d == min(groups[t]), sha(t)) for d, t in texts.items()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(op5_exact_dedup(spark, table(documents=awkward)))}
    assert got == want


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 64])
def test_exact_dedup_repeated_rows_and_recursion(repeated, bucket_bytes):
    got = rows(exact_dedup(repeated, bucket_bytes=bucket_bytes))
    assert len(got) == repeated.count()
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}


def test_exact_dedup_empty_and_kept(nothing, awkward):
    assert exact_dedup(nothing).count() == 0
    assert kept_documents(awkward).columns == awkward.columns
    assert kept_documents(awkward).count() == exact_dedup(awkward).where("kept").count()


def brute_lines(texts, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WS))
    docs = defaultdict(set)
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            docs[key(x)].add(d)
    gone = {k: max(v) for k, v in docs.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("n_batches", [1, 5])
def test_line_dedup_against_brute_force(awkward, n_batches):
    want = brute_lines({r["doc_id"]: r["text"] for r in rows(awkward)})
    got = line_dedup(awkward, n_batches=n_batches)
    assert got.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], sha(r["text"] or "")) for r in rows(got)} == want
    assert any(x[1] for x in want.values())


def test_op3_and_odd_tables(awkward, repeated, nothing, table, spark):
    want = brute_lines({r["doc_id"]: r["text"] for r in rows(awkward)})
    got = rows(op3_line_dedup(spark, table(documents=awkward)))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == want
    assert line_dedup(repeated).count() == repeated.count()
    assert line_dedup(nothing).count() == 0


def test_op2_law(awkward, table, spark):
    got = rows(op2_sharding(spark, table(documents=awkward)))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows(awkward)}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op2_writes_whole_documents(awkward, nothing, table, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "new_path", lambda spark, name: str(tmp_path / name))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows(op2_sharding(spark, table(documents=awkward)))}
    docs = {r["doc_id"]: r for r in rows(awkward)}
    back = rows(spark.read.parquet(str(tmp_path / "shards")).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()))
    assert {r["doc_id"]: {c: r[c] for c in ("text", "lang", "source", "n_chars")} for r in back} == {d: {c: r[c] for c in ("text", "lang", "source", "n_chars")} for d, r in docs.items()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back} == got
    files = defaultdict(list)
    for r in sorted(back, key=lambda r: r["at"]):
        files[r["file"]].append((r["shard"], r["slot"]))
    assert all(f == [(f[0][0], f[0][1] + k) for k in range(len(f))] for f in files.values())
    monkeypatch.undo()
    assert rows(op2_sharding(spark, table(documents=nothing))) == []


def test_shards_follow_the_key_and_are_shuffled(spark):
    df = spark.range(6000).withColumnRenamed("id", "k")
    a = {r["k"]: r for r in shuffle_shards(df, "k", 5, seed=3, bucket_bytes=4096).collect()}
    b = {r["k"]: r for r in shuffle_shards(df.repartition(7), "k", 6, seed=3).collect()}
    assert len(a) == 6000 and all(b[k]["shard"] == a[k]["grown_shard"] for k in a)
    sizes = Counter(r["shard"] for r in a.values())
    assert min(sizes.values()) > 1000
    first = sorted((r["slot"], k) for k, r in a.items() if r["shard"] == 0)
    assert [s for s, _ in first] == list(range(sizes[0]))
    ups = sum(x[1] < y[1] for x, y in zip(first, first[1:]))
    assert 0.4 < ups / len(first) < 0.6


def test_write_shards_and_odd_tables(spark, repeated, nothing, tmp_path):
    slim = repeated.select("doc_id", "text")
    out = shuffle_shards(slim, "doc_id", 4, record_bytes=F.coalesce(F.octet_length("text"), F.lit(0)))
    write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == repeated.count()
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count_distinct("slot")).alias("ok")).where("not ok").count() == 0
    assert shuffle_shards(nothing.select("doc_id"), "doc_id", 4).count() == 0


def water_fill(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        free -= over
    return target


def test_targets(spark):
    sizes = {"a": 10, "b": 500, "c": 70, None: 33, "é": 900, "Z": 1, "empty": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_op8_mix(spark, table):
    docs = [(i, None if i % 50 == 0 else " ".join(["w"] * (i * 7919 % 400)), "hot" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 5}") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    folder = table(documents=df)
    got = rows(op8_mixing(spark, folder))
    assert {r["doc_id"]: r["size"] for r in got} == {d: len((t or "").split()) for d, t, _ in docs}
    source, taken, sizes = {d: s for d, _, s in docs}, Counter(), Counter()
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        sizes[source[r["doc_id"]]] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water_fill(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (sizes[s], pytest.approx(want[s]))
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 400
    assert sorted(map(str, rows(op8_mixing(spark, folder)))) == sorted(map(str, got))


def test_mix_odd_tables(repeated, nothing):
    assert mix_sources(repeated).count() == repeated.count()
    assert mix_sources(nothing).count() == 0


def test_a_row_for_each_crossing(awkward, table, spark):
    mixed = mix_sources(awkward.select("doc_id", "source", "text"), seed=8)
    want = {r["doc_id"]: r for r in rows(mixed)}
    got = defaultdict(list)
    for r in rows(emit_copies(mixed)):
        assert r["text"] == want[r["doc_id"]]["text"]
        got[r["doc_id"]].append(r["_copy"])
    assert {d: sorted(c) for d, c in got.items()} == {d: list(range(1, r["_copies"] + 1)) for d, r in want.items() if r["_copies"]}
    taken = {r["doc_id"]: r["taken"] for r in rows(op8_mixing(spark, table(documents=awkward)))}
    assert taken == {d: r["_copies"] * r["_size"] for d, r in want.items()}
