"""Term collections of pairs, taken in the row that holds both sides."""

from collections import Counter

import numpy as np
import pytest

from twinlens.operators import coded, overlaps
from twinlens.plans import catalog, families  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f01_chargrams", "f02_important_tokens", "f05_text"])
def test_no_row_a_pair_and_term(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "term" not in plan


def test_grams_and_runs_are_told_apart_as_strings():
    s = "аbcabc😀d"
    want = Counter(s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1))
    assert sorted(overlaps.counted(overlaps.grams(s))[1]) == sorted(want.values())
    assert len(overlaps.grams("ab")) == len(overlaps.grams("")) == 0
    words = "a bc ab c a bc 12".split()
    for n, found in enumerate(overlaps.runs(words, 4), 1):
        want = ["".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        assert [found[i] == found[j] for i in range(len(found)) for j in range(len(found))] == [x == y for x in want for y in want]
    one, two, *_ = overlaps.runs(["ab", "c", "abc"], 2)
    assert two[0] == one[2] and [len(x) for x in overlaps.runs([], 4)] == [0] * 4


def test_common_entries_of_either_order():
    x, y = np.array([1, 4, 6, 9], np.uint64), np.array([4, 9, 12], np.uint64)
    for a, b in ((x, y), (y, x), (x[:0], y), (y, x[:0])):
        i, j = overlaps.met(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_words_come_back_with_frequencies_of_all_chunks(spark):
    texts = [("red", "a b b"), ("", "b c"), ("red red", ""), (None, None), ("b", "a c")]
    docs = spark.createDataFrame([(i, *texts[i % 5]) for i in range(40)], "doc_id long, title string, description string").repartition(3)
    found, n, means = coded.coded(docs, "doc_id", "title", "description")
    rows = {r.doc_id: bytes(r.words) for r in found.collect()}
    assert n == len(rows) == 40 and means == pytest.approx([8 * 4 / 40, 8 * 7 / 40, 8 * 11 / 40])
    ids, (n_1, n_2, df_1, df_2, df_3) = coded._unpacked(rows[0])
    assert sorted(zip(n_1, n_2, df_1, df_2, df_3)) == [(0, 1, 0, 16, 16), (0, 2, 0, 16, 24), (1, 0, 16, 0, 16)]
    assert rows[0] == rows[5] and len(coded._unpacked(rows[3])[0]) == 0
