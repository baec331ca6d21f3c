import numpy as np

from twinlens.operators import learning
from twinlens.operators.extra_trees import ExtraTrees


def planted(spark, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)  # no single feature tells
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, label double")


def test_trees_learn_what_no_single_feature_tells(spark):
    rows = planted(spark).cache()
    train, unseen = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    model = ExtraTrees(trees=12, depth=7, drawn=4).fit(train, list("abcde"))
    assert learning.auc(model.transform(unseen)) > 0.9
    for feature, threshold, left, share in model.forest:
        assert ((share >= 0) & (share <= 1)).all() and (left[feature >= 0] > 0).all() and len(feature) <= 2**8


def test_the_same_trees_however_rows_are_dealt(spark):
    rows = planted(spark, 200)
    fit = lambda df, **k: ExtraTrees(trees=2, depth=3, entropy=False, **k).fit(df, list("abcde")).forest
    one, two, other = fit(rows.repartition(1)), fit(rows.repartition(5)), fit(rows, seed=7)
    assert all((a == b).all() for x, y in zip(one, two) for a, b in zip(x, y))
    assert any(len(x[0]) != len(y[0]) or (x[1] != y[1]).any() for x, y in zip(one, other))


def test_leaves_of_few_rows_and_of_one_label(spark):
    one = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, label double")
    assert [t[0].tolist() for t in ExtraTrees(trees=1, depth=3).fit(one, ["a"]).forest] == [[-1]]
    model = ExtraTrees(trees=1, depth=3).fit(one.where("false"), ["a"])
    assert model.transform(one).first().score == 0.5
