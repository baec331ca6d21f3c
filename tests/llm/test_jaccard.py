import random
import re

import numpy as np
import pytest

from twinlens.llm import jaccard
from twinlens.llm.components import connected_components


def rows(df):
    return [r.asDict() for r in df.collect()]


def sets_of(texts, n_words):
    out = {}
    for d, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n_words, len(w))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    return out


def brute(texts, n_words, percent):
    sets = sets_of(texts, n_words)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed, n=150):
    """Texts of all sizes with copies at all distances around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(n):
        if d % 3 and texts:
            w = texts[rng.choice(list(texts))].split()
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[rng.randint(0, 2) :]
        else:
            w = rng.choices(vocabulary, k=rng.choice((1, 2, 3, 9, 10, 11, 12, 20, 40, 90, 200, 500)))
        texts[d * 5 % 1009] = " ".join(w)
    return texts


@pytest.mark.parametrize("seed,n_words,percent,block", [(1, 3, 90, 256), (2, 5, 80, 256), (3, 1, 90, 8), (4, 3, 60, 8)])
def test_components_against_brute_force(spark, monkeypatch, seed, n_words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = family(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = rows(jaccard.jaccard_components(df, n_words=n_words, percent=percent))
    want = brute(texts, n_words, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({w[1] for w in want.values()}) < len(want)


def test_op9_and_odd_tables(awkward, repeated, nothing, table, spark):
    texts = {r["doc_id"]: r["text"] for r in rows(awkward)}
    want = brute(texts, 3, 90)
    got = rows(jaccard.op9_jaccard_join(spark, table(documents=awkward)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    again = rows(jaccard.jaccard_components(repeated, n_words=3, percent=90))
    assert len(again) == repeated.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in again if r["doc_id"] is not None} == want
    assert jaccard.jaccard_components(nothing).count() == 0
    kept = {r["doc_id"] for r in rows(jaccard.keep_one(awkward, n_words=3, percent=90))}
    assert kept == {d for d, w in want.items() if w[1] == d}


def test_nodes_are_met_by_every_linked_pair():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        nodes = jaccard.Nodes(percent)
        for _ in range(300):
            n = int(rng.choice([*range(1, 40), 100, 300]))
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            drop = int(rng.integers(0, nodes.differ(len(a)) + 2))
            b = np.unique(np.r_[a[drop // 2 :], rng.integers(0, 1 << 62, drop - drop // 2).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            doc, keys = nodes.keys(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.array([len(a), len(b)]))
            assert set(keys[doc == 0]) & set(keys[doc == 1])


def test_components_of_a_path(spark):
    n = 300
    links = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["id"]: r["component"] for r in rows(connected_components(links))}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def brute_pairs(texts, n_words, percent):
    """(class of each document, links between classes)."""
    sets = sets_of(texts, n_words)
    least = {}
    for d in sorted(sets):
        least.setdefault(frozenset(sets[d]), d)
    classes = sorted(d for s, d in least.items() if s)
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    links = {(a, b) for i, b in enumerate(classes) for a in classes[:i] if linked(a, b)}
    return {d: least[frozenset(s)] if s else d for d, s in sets.items()}, links


@pytest.mark.parametrize("seed,n_words,percent,block", [(1, 3, 90, 256), (2, 1, 60, 8), (4, 3, 60, 3)])
def test_every_link_against_brute_force(spark, monkeypatch, seed, n_words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = family(seed)
    base = [f"b{i}" for i in range(300)]
    for k in range(30):  # all near each other
        texts[2000 + k] = " ".join(base[:40 + k] + [f"edit{k}"] + base[40 + k :])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    df = df.union(df.where("doc_id % 4 = 0"))
    classes, want = brute_pairs(texts, n_words, percent)
    members, links = jaccard.jaccard_classes(df, n_words=n_words, percent=percent)
    got = [(r["a"], r["b"]) for r in rows(links)]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(a >= 2000 for a, _ in got) == 30 * 29 // 2
    assert {r["id"]: r["class_id"] for r in rows(members)} == classes
    n_links = {d: sum(c in x for x in want) for d, c in classes.items()}
    counted = rows(jaccard.jaccard_components(df, n_words=n_words, percent=percent))
    assert {r["doc_id"]: r["n_links"] for r in counted} == n_links
    top = {d: c for d, (_, c) in brute(texts, n_words, percent).items()}
    assert {r["doc_id"]: r["component_id"] for r in counted} == top
