import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")
from twinlens.llm import alignment  # noqa: E402


@pytest.fixture(scope="module")
def tokenizers():
    with open(alignment.default_model(), "rb") as f:
        t = alignment.Tokenizers(open(alignment.default_bpe(), encoding="utf-8").read(), f.read())
    t.load()
    return t


def of_text(text, tokenizers):
    """(tokens of both, groups, links, digest) by whole texts, or None."""
    a, b, bytes_a, bytes_b = tokenizers.load()
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    said_a, said_b = [bytes_a.get(i, b"") for i in ids_a], [bytes_b.get(i, b"") for i in ids_b]
    if not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, said_a))), list(accumulate(map(len, said_b)))
    links, groups, k = [], [], 0
    for i, y in enumerate(ends_a):
        x = y - len(said_a[i])
        while ends_b[k] <= x:
            k += 1
        j = k
        while j < len(ends_b) and ends_b[j] - len(said_b[j]) < y:
            links.append((ids_a[i], ids_b[j]))
            j += 1
    at = 0
    for e in sorted({*ends_a} & {*ends_b}):
        x, z = ([ids[i] for i, y in enumerate(ends) if at < y <= e] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)))
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, z)))
        at = e
    return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute(texts, tokenizers):
    docs = [of_text(t, tokenizers) for t in texts]
    counts, best = Counter(p for d in docs if d for p in set(d[3])), defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(*d[:3], len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) if d else (0,) * 6 + ("",) for d in docs]


def odd_texts():
    out = ["<|endoftext|> </s> <s>", "a▁b", "x ▁", "tab\tand \n\n  many   spaces  ", "  lead", "trail ", "it's we'll 'S", "漢字かな交じり文", "a b  c　 d\u0085 e  f", "\x1c \x1f a", "🙂🙂 👩‍👩‍👧", "\x00 nul", "ﬁ Å", "1234567 890", "don't stop’s …  ", "​ ​", " ", "\n", "é́ e"]
    return out + ["".join(chr(33 + (i * 7919) % 90) for i in range(5000)), "word " * 3000]


def test_units_are_what_whole_texts_give(tokenizers):
    units = alignment.Units(tokenizers)
    for text in odd_texts():
        data = np.frombuffer(text.encode(), np.uint8)
        sums, digest, doc, pair, times = alignment._counted(np.array([0, len(data)]), data, units)
        want = of_text(text, tokenizers)
        assert (*sums[0][:3], digest[0]) == ((*want[:3], want[4]) if want else (0, 0, 0, "")), text
        links = Counter(want[3]) if want else {}
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pair, times)} == links


def test_op13_against_brute_force(awkward, spark, table, tokenizers):
    extra = [(7000 + i, t, "en", "s", 1, "k", "s", "i") for i, t in enumerate(odd_texts())]
    docs = awkward.union(spark.createDataFrame(extra, awkward.schema)).repartition(4)
    rows = docs.collect()
    got = alignment.op13_alignment(spark, table(documents=docs))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], tokenizers)))
    assert f"struct<{','.join(x.replace(' ', ':').replace('long', 'bigint') for x in alignment.DIGEST.split(', '))}>" == got.schema.simpleString()


def test_small_chunks_salts_and_stripes_change_nothing(awkward, spark, tokenizers, monkeypatch):
    df = awkward.where("doc_id % 3 = 0 and length(text) < 5000")
    want = sorted(map(tuple, alignment.align(df).collect()))
    monkeypatch.setattr(alignment, "SALTED", 2)
    assert sorted(map(tuple, alignment.align(df.repartition(11), stripes=7).collect())) == want


def test_long_texts_in_pieces(tokenizers, monkeypatch):
    text = ("some words, " * 900 + "é  " * 300 + "\n\n") * 3
    data = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(data)])
    want = alignment._counted(off, data, alignment.Units(tokenizers))
    monkeypatch.setattr(alignment, "CHUNK", 1000)
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    got = alignment._counted(off, data, alignment.Units(tokenizers))
    assert want[1] == got[1] and all((x == y).all() for x, y in zip((want[0], *want[2:]), (got[0], *got[2:])))


def test_odd_tables(repeated, nothing):
    out = alignment.align(repeated)
    assert out.count() == repeated.count() and out.where("doc_id is null").count() == 1
    assert alignment.align(nothing).count() == 0
