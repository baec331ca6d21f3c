"""Contacts are looked for where they can be, and compared where both sides have any."""

import random

from pyspark.sql import functions as F

from twinlens.functions import contact
from twinlens.operators import matching
from twinlens.operators import pairs as both
from twinlens.plans import families


def test_tests_before_the_patterns_rule_nothing_out_that_they_find(spark):
    rng = random.Random(5)
    parts = ["@", "@@", ".", "./", "/.", "ru", "com", ".ru", "a", "ж", "shop", "www.", "https://", "#", "тег", "/", " ", ",", "89", "7", "1234", "912 345-67-89", "8 (912) 345 67 89", "a.b@shop.ru", "-", ")", "ё"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", "..", "a@b.ru", "./ab.ru", "x./.ru"]
    t, every = F.col("t"), contact.contacts(F.col("t"))
    guarded = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[c.alias(n) for n, c in every.items()]).collect()
    contact._unless, kept_as = (lambda ruled_out, found: found), contact._unless
    try:
        plain = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[c.alias(n) for n, c in contact.contacts(t).items()]).collect()
        nulls = [c for c in (contact.links(t), contact.emails(t), contact.phones(t))]
    finally:
        contact._unless = kept_as
    assert guarded == plain
    assert all(any(r[n] for r in guarded) for n in every)
    none = spark.createDataFrame([(None,)], "t string")
    assert none.select(*nulls).first() == none.select(contact.links(t), contact.emails(t), contact.phones(t)).first()


def test_only_pairs_whose_both_sides_have_contacts_are_compared(spark, monkeypatch):
    """Null ids, items without contacts, items that come twice and pairs of unknown items."""
    texts = [(1, "a@b.ru shop.ru #x"), (2, "a@b.ru #y"), (3, "nothing"), (4, "shop.ru/a 8 912 345-67-89"), (4, "shop.ru/a 8 912 345-67-89"), (None, "a@b.ru"), (5, None), (6, "@@k@@ #x")]
    items = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (1, 4), (4, 6), (1, 6), (None, None), (None, 1), (7, 8)], "id_1 long, id_2 long")
    monkeypatch.setattr(families, "pairs_and_items", lambda s, d: (pairs, items))
    compared, matches = [], matching.matches
    monkeypatch.setattr(matching, "matches", lambda p, *rest: (compared.append(p), matches(p, *rest))[1])
    got = families.contacts(spark, "")
    assert sorted((r.id_1, r.id_2) for r in compared[0].collect()) == [(1, 2), (1, 4), (1, 6), (2, 4), (4, 6)]

    found = contact.contacts(F.col("text"))
    known = contact.with_any(items.select("doc_id", *[c.alias(n) for n, c in found.items()]), list(found)).withColumn("all", F.concat("emails", "links", "phones", "hashtags"))
    names = ["placeholders", *families._KINDS, "all"]
    similar = matching.wide(matches(pairs, matching.collections(known, "doc_id", {n: F.col(n) for n in names}), "doc_id", names), names, ["cos", "jaccard_reg"])
    x = both.with_both(similar, known.select("doc_id", *[F.size(n).alias(n) for n in names[1:]]), "doc_id")
    of_both = F.col("all_1").isNotNull() & F.col("all_2").isNotNull()
    every = x.select("id_1", "id_2", F.when(of_both, F.col("placeholders_cos")).alias("cosine_placeholders"), *[c for n in names[1:] for c in (F.when(of_both, F.col(f"{n}_jaccard_reg")).alias(f"{n}_jaccard"), F.abs(F.col(f"{n}_1") - F.col(f"{n}_2")).alias(f"{n}_len_diff"))])
    assert got.dtypes == every.dtypes and sorted(map(str, got.collect())) == sorted(map(str, every.collect())) and got.count() == 13
