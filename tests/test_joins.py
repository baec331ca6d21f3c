"""Joins and counts of items that are too many for the driver or for one task."""

import pytest

from twinlens.operators import pairs as both
from twinlens.plans import catalog, measures  # noqa: F401

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d03_chargram_cosine", "j03_pair_features", "j05_joined_pair_features", "u04_symmetric_difference"])
def test_pairs_of_items_are_not_broadcast(spark, name):
    assert "Broadcast" not in _plan(catalog.QUERIES[name](spark, SF))


def test_items_are_dealt_before_their_terms_are_counted(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(k, "a b a") for k in range(40)] + [(0, "b")], "k long, t string").coalesce(1)
    found = both.counts(items, "k", F.split("t", " "))
    plan = _plan(found)
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(k")  # printed from the top
    assert plan.count("Exchange") == 1
    assert {(r.k, r.term, r.n) for r in found.where("k < 2").collect()} == {(0, "a", 2), (0, "b", 2), (1, "a", 2), (1, "b", 1)}


def test_sentence_vectors_are_summed_without_a_row_a_component(spark):
    found = catalog.QUERIES["d08_sentence_vectors"](spark, SF)
    plan = _plan(found)
    assert "posexplode" not in plan and "Broadcast" not in plan
    rows = found.collect()
    assert {r.kind for r in rows} == {"all", "excluded"} and len({(r.id_1, r.kind) for r in rows}) == len(rows)


def test_attribute_terms_of_items_are_not_broadcast(spark):
    from twinlens.plans.families import attribute_terms

    pairs, _, terms = attribute_terms(spark, SF)
    assert "Broadcast" not in _plan(pairs) and "Broadcast" not in _plan(terms)
