import hashlib
import random

import pytest

from twinlens.llm import suffix


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute(texts, match=100):
    first, spans = {}, {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            s = b[i : i + match]
            if s in first:
                gone[i : i + match] = b"\1" * match
            else:
                first[s] = (d, i)
        runs = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans[d] = (len(b), sum(gone), len(runs), hashlib.sha256(kept).hexdigest())
    return spans


def test_op7_against_brute_force(awkward, table, spark):
    want = brute({r["doc_id"]: r["text"] for r in rows(awkward)})
    got = rows(suffix.op7_suffix_dedup(spark, table(documents=awkward)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(x[1] > 0 for x in want.values()) > 10


@pytest.mark.parametrize("match,n_batches,hot", [(12, 1, 9999), (12, 5, 3), (40, 3, 2), (40, 2, 9999)])
def test_spans_against_brute_force(spark, monkeypatch, match, n_batches, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(match + n_batches)
    passage = "".join(rng.choices("abcdefé ", k=300))
    texts = {}
    for d in range(120):
        a, b = sorted(rng.sample(range(300), 2))
        texts[d * 2 - 7] = "".join(rng.choices("ab", k=rng.randint(0, 40))) + passage[a:b] + "".join(rng.choices("xyz", k=rng.randint(0, 30))) + "aaaa" * rng.randint(0, 15)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    cut = suffix.remove_spans(df, suffix.repeated_spans(df, match=match, n_batches=n_batches))
    want = brute(texts, match)
    assert {r["doc_id"]: (r["_spans"] and len(r["_spans"]) or 0, hashlib.sha256(r["_kept"]).hexdigest()) for r in rows(cut)} == {d: w[2:] for d, w in want.items()}


def test_odd_tables(repeated, awkward, nothing):
    spans = {r["doc_id"]: r["spans"] for r in rows(suffix.repeated_spans(repeated))}
    assert spans == {r["doc_id"]: r["spans"] for r in rows(suffix.repeated_spans(awkward))}
    assert suffix.repeated_spans(nothing).count() == 0
    cut = suffix.remove_spans(repeated, suffix.repeated_spans(repeated))
    assert cut.count() == repeated.count() and "kept" in cut.columns
