"""What the entry file registers, with and without the corpus operators."""

import __spark_entry__ as entry
from twinlens.plans import catalog


def test_every_oracle_has_a_query_and_each_survey_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert len(catalog.ORACLES) >= 60
