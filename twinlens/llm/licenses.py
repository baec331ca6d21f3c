"""Licence texts in documents, by a positional index of their rare words.

Templates are word sequences with phrases that must be there. A document keeps the
places of the words that any template has. Its rarest ones (by documents of the whole
corpus) look up postings (template, place); a place in the document less a place in the
template is where the template would begin, and beginnings that several rare words
share are candidates. A candidate stands if the template's key phrases stand at
their places. All of this is row by row, in array functions: nothing but counts of
words by documents is shuffled, however skewed the documents are.

Numbers: a candidate is template * 2**40 + its begin + _BEFORE, its words are that times
_WORDS plus the word's number.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import quoted, stored

#: Words of a text before A-Z are lower-cased, as long as no other letters are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Long texts are taken in parts that end with a word, of this many characters or some more.
_LONG, _PART = 1 << 18, r"(?s).{1,65536}+[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+"
_BEFORE, _WORDS, _TEMPLATE = 4096, 1024, 1 << 40
_MARK = _WORDS - 1
#: What a mention counts that stands in no template found.
MENTION = 0.25


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Public licence notices and the phrases without which they are not theirs.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version 3 of the license or at your option any later version",
        ("under the terms of the gnu general public license",),
    ),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


class Index:
    """Numbered words of templates and phrases, with postings."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates, self.phrases = tuple(templates), tuple(phrases)
        texts = [t.text.split() for t in self.templates]
        self.words = sorted({w for t in texts for w in t} | {w for p, _ in self.phrases for w in p.split()})
        if len(self.words) >= _MARK or any(len(t) > _BEFORE for t in texts) or any(not re.fullmatch("[0-9a-z]+", w) for w in self.words):
            raise ValueError(f"templates have {_BEFORE} words at most, of {_MARK - 1} lower-case ASCII words in all")
        self.number = {w: i for i, w in enumerate(self.words)}
        self.postings: list[list[int]] = [[] for _ in self.words]
        for t, text in enumerate(texts):
            for at, w in enumerate(text):
                self.postings[self.number[w]].append(t * _TEMPLATE - at + _BEFORE)
        # (words of a key phrase, place in the template) by template
        self.keys = [[(k.split(), next(i for i in range(len(text)) if text[i : i + len(k.split())] == k.split())) for k in t.keys] for t, text in zip(self.templates, texts)]

    def rarity(self, documents: int, counts: dict[int, int]) -> list[float]:
        return [math.log1p(documents / max(counts.get(i, 0), 1)) for i in range(len(self.words))]

    def weights(self, idf: list[float]) -> list[float]:
        """What all words of each template weigh, added up in order of their numbers."""
        out = []
        for t in self.templates:
            total = 0.0
            for i in sorted(self.number[w] for w in t.text.split()):
                total += idf[i]
            out.append(total)
        return out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _list(values, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def word_places(text: Column, index: Index) -> Column:
    """(n: words of the text, hits: (at, word) of those in the index, in order)."""
    numbers = _list(index.words, "string")

    def hit(x, i):
        low = F.lower(x)
        known = (F.octet_length(x) == F.char_length(x)) & low.isin(index.words)
        return F.when(known, F.struct(i.cast("long").alias("at"), (F.array_position(numbers, low) - 1).cast("int").alias("word")))

    def part(p):
        return _let(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_compact(F.transform(w, hit)).alias("hits")))

    def joined(parts):
        begins = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["n"])))
        moved = lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(p["hits"], lambda h: F.struct((h["at"] + F.get(b, k)).alias("at"), h["word"].alias("word")))))
        return _let(begins, lambda b: F.struct(F.element_at(b, -1).alias("n"), moved(b).alias("hits")))

    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) <= _LONG, part(text)).otherwise(_let(F.transform(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), part), joined))


def phrase_places(hits: Column, words: list[int]) -> Column:
    """Where the words of a phrase stand one after the other."""

    def begin(h, i):
        fits = h["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            fits = fits & F.coalesce((F.get(hits, i + k)["word"] == w) & (F.get(hits, i + k)["at"] == h["at"] + k), F.lit(False))
        return F.when(fits, h["at"])

    return F.array_compact(F.transform(hits, begin))


def candidates(hits: Column, index: Index, idf: list[float], rare: int, aligned: int) -> Column:
    """Beginnings of templates that `aligned` of the document's rarest words share."""
    rarity, postings = _list(idf, "double"), F.array(*[_list(p, "bigint") for p in index.postings])

    def chosen(words):
        ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.get(rarity, w)).alias("r"), w.alias("w"))))
        return F.transform(F.slice(ranked, 1, rare), lambda x: x["w"])

    def begins(some):
        found = F.transform(F.filter(hits, lambda h: F.array_contains(some, h["word"])), lambda h: F.transform(F.get(postings, h["word"]), lambda p: (p + h["at"]) * _WORDS + h["word"]))
        return F.sort_array(F.array_distinct(F.flatten(found)))

    def shared(codes):
        whole = lambda x: F.shiftright(x, 10)
        return F.array_distinct(F.array_compact(F.transform(codes, lambda x, i: F.when(whole(x) == whole(F.get(codes, i + aligned - 1)), whole(x)))))

    return _let(_let(F.array_distinct(F.transform(hits, lambda h: h["word"])), chosen), lambda some: _let(begins(some), shared))


def _added(places: Column, n: int) -> Column:
    return F.transform(places, lambda at: at + F.lit(n).cast("long"))


def verified(hits: Column, found: Column, index: Index) -> Column:
    """Candidates whose key phrases stand at their places."""
    kept = []
    for t, keys in enumerate(index.keys):
        codes = found
        for words, place in keys:
            codes = F.array_intersect(codes, _added(phrase_places(hits, [index.number[w] for w in words]), t * _TEMPLATE + _BEFORE - place))
        kept.append(codes)
    return F.concat(*kept)


def share(hits: Column, found: Column, index: Index, idf: list[float]) -> Column:
    """The largest share, by weight, of a found template's words that stand at their places."""
    rarity, weights = _list([*idf, *[0.0] * (_WORDS - len(idf))], "double"), _list(index.weights(idf), "double")
    postings = F.array(*[_list(p, "bigint") for p in index.postings])
    words = F.flatten(F.transform(hits, lambda h: F.transform(F.get(postings, h["word"]), lambda p: (p + h["at"]) * _WORDS + h["word"])))
    marks = F.transform(found, lambda c: c * _WORDS + _MARK)

    def step(acc, x):
        code = F.shiftright(x, 10)
        total = F.when(code == acc["code"], acc["total"]).otherwise(0.0)
        best = F.when(x % _WORDS == _MARK, F.greatest(acc["best"], total / F.get(weights, F.shiftright(code, 40).cast("int")))).otherwise(acc["best"])
        return F.struct(code.alias("code"), (total + F.get(rarity, (x % _WORDS).cast("int"))).alias("total"), best.alias("best"))

    start = F.struct(F.lit(-1).cast("long").alias("code"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sort_array(F.concat(words, marks)), start, step, lambda acc: acc["best"])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, rare: int = 32, aligned: int = 2) -> DataFrame:
    """Per document: id_col, n_words, mentions (label, at) of the phrases, places (label, at)
    of verified templates, at being the word where one begins (below 0 if its first words
    are cut off), and score: the largest share of a template found, by weight of words;
    MENTION at least where a phrase stands, else 0.

    Rarity is over all documents. Of each document the `rare` rarest words are looked up,
    ties by the word; candidates have `aligned` of them in line. A null text is empty; each row
    is a document, repeated ones and those with a null id too; other columns are not read; an empty
    table gives an empty one.
    """
    index = Index(templates, phrases)
    if any(len({*t.text.split()}) < aligned for t in index.templates):
        raise ValueError("templates need as many different words as have to be in line")
    own = df.select(F.col(quoted(id_col)).alias(id_col), word_places(F.col(quoted(text_col)), index).alias("_r"))
    own = stored(own, "license-words")
    counts = own.select(F.explode(F.array_distinct(F.transform("_r.hits", lambda h: h["word"]))).alias("w")).groupBy("w").count()
    idf = index.rarity(own.count(), {r.w: r["count"] for r in counts.collect()})  # a row a word of the templates
    hits = F.col("_r.hits")
    labels = _list([t.label for t in index.templates], "string")

    def judged(found):
        places = F.transform(found, lambda c: F.struct(F.get(labels, F.shiftright(c, 40).cast("int")).alias("label"), (c % F.lit(_TEMPLATE) - _BEFORE).alias("at")))
        return F.struct(places.alias("places"), F.when(F.size(found) > 0, share(hits, found, index, idf)).otherwise(0.0).alias("score"))

    none = F.array().cast("array<bigint>")
    maybe = candidates(hits, index, idf, rare, aligned)
    found = _let(maybe, lambda c: F.when(F.size(c) > 0, verified(hits, c, index)).otherwise(none))

    def mentioned(phrase, label):
        return F.transform(phrase_places(hits, [index.number[w] for w in phrase.split()]), lambda at: F.struct(F.lit(label).alias("label"), at.alias("at")))

    mentions = F.concat(*(mentioned(*p) for p in index.phrases))
    out = own.select(quoted(id_col), F.col("_r.n").alias("n_words"), mentions.alias("mentions"), _let(found, judged).alias("_j"))
    score = F.greatest(F.col("_j.score"), F.when(F.size("mentions") > 0, MENTION).otherwise(0.0))
    return out.select(quoted(id_col), "n_words", "mentions", F.col("_j.places").alias("places"), score.alias("score"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_licenses() of every row and whole text of documents."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    at, base, own = F.col("mentions.at"), F.col("mentions.label"), F.col("places.label")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.size("mentions").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), "score",
    )
