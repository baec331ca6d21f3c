import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, anchor string, rank int"


def brute(rows, is_anchor, label, n_pos=5, n_neg=3):
    """The contract, in Python integers. rows: (id, vector, label)."""
    ok = [(i, label(i, y), [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {(i, y, tuple(v)) for i, y, v in ok if is_anchor(i)}
    out = []
    for a, y, v in anchors:
        scored = sorted((-dot(v, w), i, z) for i, z, w in ok)
        for s, p, _ in [x for x in scored if x[2] == y and x[1] != a][:n_pos]:
            hard = [(t, i) for t, i, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(hard, 1)]
    return sorted(out)


def moved(i, y):
    return (y + 1) % 10 if i % 7 == 0 else y


def vectors(n, seed, width=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        y = int(rng.integers(4))
        rows.append((i, [float(x) for x in (centre[y] + rng.normal(size=width) * 0.8).astype(np.float32)], y))
    return rows


@pytest.fixture(scope="module")
def odd():
    """Nulls everywhere, short and empty vectors, ties, repeated rows and anchors."""
    rows = vectors(400, 3)
    rows += [(400, None, 1), (401, rows[1][1], None), (None, rows[2][1], 1), (450, [], 2), (451, rows[3][1][:5], 0)]
    rows += [(452, [None, *rows[4][1][1:]], 1), (453, [float("nan")] * 12, 1), (454, [float("inf")] * 12, 0)]
    rows += [(500 + k, rows[50][1], rows[50][2] if k % 2 else 3) for k in range(40)]  # one vector under two labels
    rows += [rows[50], rows[50], rows[7], rows[7]]
    random.Random(1).shuffle(rows)
    return rows


def table_of(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, y, i, "v", "a", 1) for i, v, y in rows], SCHEMA).repartition(parts)


def test_op11_against_brute_force(spark, odd, table):
    got = negatives.op11_hard_negatives(spark, table(embeddings=table_of(spark, odd)))
    want = brute(odd, lambda i: i % 50 == 0, moved)
    assert len(want) > 20
    assert sorted(map(tuple, got.collect())) == want
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"


def test_small_blocks_and_parameters_give_the_same(spark, odd):
    df = table_of(spark, odd, 3)
    label = F.col("label")
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, label, positives=2, negatives=4, block_bytes=12 * 16 * 9)
    assert sorted(map(tuple, got.collect())) == brute(odd, lambda i: i % 10 == 0, lambda i, y: y, 2, 4)


def test_no_rows_and_no_anchors(spark, odd):
    df = table_of(spark, odd)
    for some in (df.where("false"), df.where("vec_id = 1")):
        assert negatives.mine_hard_negatives(some, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine_hard_negatives(df, F.col("vec_id") == 0, F.col("label"))


def test_bounds_leave_few_pairs_and_lose_none():
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = np.floor(rng.normal(size=(3000, 64)) * np.geomspace(200, 2, 64) @ basis).astype(np.int64)
    values, axes = np.linalg.eigh(x.T.astype(float) @ x)
    r = negatives.Rotation(np.ascontiguousarray(axes[:, ::-1]), 30, True, values[::-1])
    block = negatives.Block(np.arange(30), np.zeros(30, np.int64), x[:30], r)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(np.zeros(3000, np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype=np.int32) * 64), pa.array(x.ravel()))], names=["id", "label", "v"])
    seen = {}
    best = block.positives([batch], 5, seen)
    exact = x[:30] @ x.T
    exact[np.arange(30), np.arange(30)] = -(1 << 62)
    assert (best.score == -np.sort(-exact, 1)[:, :5]).all()
    assert seen[32] < 0.2 * seen[0]
