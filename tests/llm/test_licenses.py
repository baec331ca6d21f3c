import math
import re
from collections import Counter

import pytest

from twinlens.llm import licenses
from twinlens.llm.licenses import MENTION, PHRASES, TEMPLATES, Template


def brute(texts, rare=32, aligned=2, templates=TEMPLATES):
    """Rows of op12 but for doc_id, by lists of words."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    known = {w for t in templates for w in t.text.split()} | {w for p, _ in PHRASES for w in p.split()}
    counts = Counter(w for x in words for w in set(x) & known)
    idf = {w: math.log1p(len(words) / max(counts[w], 1)) for w in known}
    at = lambda x, phrase: [i for i in range(len(x)) if x[i : i + len(phrase.split())] == phrase.split()]
    out = []
    for x in words:
        mentions = [(label, i) for p, label in PHRASES for i in at(x, p)]
        top = sorted(set(x) & known, key=lambda w: (-idf[w], w))[:rare]
        best, labels = 0.0, set()
        for t in templates:
            own, lines = t.text.split(), {}
            for i, w in enumerate(x):
                for j in (j for j, v in enumerate(own) if w == v and w in top):
                    lines.setdefault(i - j, set()).add(w)
            for d, s in lines.items():
                if len(s) >= aligned and all(d + at(own, k)[0] in at(x, k) for k in t.keys):
                    labels.add(t.label)
                    best = max(best, sum(idf[w] for j, w in enumerate(own) if 0 <= d + j < len(x) and x[d + j] == w) / sum(idf[w] for w in own))
        base, places = {b for b, _ in mentions}, [i for _, i in mentions]
        out.append((len(x), len(mentions), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), pytest.approx(max(best, MENTION if mentions else 0))))
    return out


def texts():
    mit, gpl = TEMPLATES[1].text, TEMPLATES[7].text
    edited = mit.split()
    edited[11] = "anyone"
    broken = mit.replace("free of charge", "for a fee")
    cased = "Licensed under the Apache-License, Version 2.0;\nGNU general\tPublic LICENSE"
    out = [mit, f"one two {gpl.upper()} three", " ".join(edited), broken, cased, "The MIT License. The MIT license! mit", "cc-by and CC BY 4.0", "GNU general é public license", "worK mit licenſe İ gnu"]
    out += [f"{'word ' * 30}{mit}\n{gpl}\n" * 3, "all rights reserved", gpl[40:], "license " * 300 + "mit license " * 200, "free free free software software copy copy"]
    long = ("lorem ipsum dolor\n" * 4000 + "x" * 70_000 + " ") * 3
    return out + [long + mit + " " + long + "apache license", "é" * 140_000 + " gnu general public license"]


def test_op12_against_brute_force(awkward, spark, table):
    own = [(5000 + i, t, "en", "s", 1, "k", "s", "i") for i, t in enumerate(texts())]
    docs = awkward.union(spark.createDataFrame(own, awkward.schema)).repartition(3)
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    got = licenses.op12_licenses(spark, table(documents=docs))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    labels = {i: want[5000 + i][5] for i in range(12)}
    assert labels[0] == "mit" and labels[1] == "gpl" and labels[3] == "" and labels[6] == "cc-by" and labels[10] == "all-rights-reserved"
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5 + ["string"] * 2 + ["double"]


def test_parts_of_long_texts_give_the_same(spark):
    text = texts()[-2]
    df = spark.createDataFrame([(1, text), (2, "a" * licenses._LONG + "bc d\n mit license"), (3, " \n" * licenses._LONG)], "id long, text string")
    out = {r.id: r for r in licenses.scan_licenses(df, id_col="id").collect()}
    assert out[1].n_words == len(re.findall(r"\w+", text)) and [p.label for p in out[1].places] == ["mit"]
    assert [(m.label, m.at) for m in out[2].mentions] == [("mit", 2)] and out[3].n_words == 0
    at = text.split().index("permission")
    assert out[1].places[0].at == at


def test_own_templates_and_few_rare_words(spark):
    own = (Template("x", "alpha beta gamma delta", ("beta gamma",)), Template("y", "beta alpha", ("beta alpha",)))
    said = ["alpha beta gamma delta", "beta gamma", "beta gamma delta alpha", "gamma beta alpha", "beta beta gamma alpha delta"] * 2
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for rare, aligned in ((32, 2), (2, 2), (3, 1)):
        got = {r.doc_id: (sorted({p.label for p in r.places}), r.score) for r in licenses.scan_licenses(df, templates=own, rare=rare, aligned=aligned).collect()}
        want = brute(said, rare, aligned, own)
        assert {i: (",".join(x), s) for i, (x, s) in got.items()} == {i: (w[5], w[6]) for i, w in enumerate(want)}


def test_odd_tables(repeated, nothing, spark):
    out = licenses.scan_licenses(repeated)
    assert out.count() == repeated.count() and out.where("doc_id is null").count() == 1
    assert out.columns == ["doc_id", "n_words", "mentions", "places", "score"]
    assert licenses.scan_licenses(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(nothing, aligned=4)


def test_main_path_has_no_python(spark, awkward):
    plan = licenses.scan_licenses(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
