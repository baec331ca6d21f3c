"""Folds, out-of-fold predictions and stacking with Spark's own learners."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept
from . import sparse
from .extra_trees import ExtraTrees


def fold(*keys: str, k: int = 4, seed: int = 42) -> Column:
    """0 to k - 1 by the keys' hash: the same row is in the same fold in any run."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(k)).cast("int")


def linear(c: float, rows: int) -> LogisticRegression:
    """L1-regularised; c is the weight of the losses' sum against the penalty."""
    return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * rows), standardization=False)


def stacker(c: float, rows: int) -> LogisticRegression:
    return LogisticRegression(regParam=1.0 / (c * rows), standardization=False)


# What the boosted trees are set to.
BOOSTED = {"maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.86, "featureSubsetStrategy": "0.55"}


def boosted(rounds: int = 100, seed: int = 42, rng: random.Random | None = None) -> GBTClassifier:
    """Boosted trees; with rng, the share of rows of a round is jittered and the seed drawn."""
    how = dict(BOOSTED)
    if rng is not None:
        how["subsamplingRate"], seed = min(1.0, jitter(how["subsamplingRate"], rng)), rng.randrange(1 << 30)
    return GBTClassifier(maxIter=rounds, seed=seed, **how)


def prepared(columns: list[str], components: int | None = None) -> list:
    """Stages that fill nulls with medians, scale, and take principal components."""
    filled = [f"_{c}" for c in columns]
    stages = [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw")]
    stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled" if components else "features", withMean=True))
    return stages + ([PCA(k=components, inputCol="_scaled", outputCol="features")] if components else [])


def component_scores(df: DataFrame, key: str, columns: list[str], components: int, c: float, folds: int = 4, **how) -> DataFrame:
    """df (key, label, fold, columns) with score: an L1-penalised learner of the other folds, on
    principal components of all rows' filled and scaled columns; rows with a null label by one
    of all labelled rows. df should be stored: it is scanned several times."""
    stages = prepared(columns, components)
    found = Pipeline(stages=stages).fit(df).transform(df).select(key, F.posexplode(vector_to_array("features")).alias("i", "value"))
    rows = kept(found.select(key, F.concat(F.lit("c"), F.col("i")).alias("term"), "value"), "components")
    return sparse.out_of_fold(rows, df, key, c, folds, **how)


def out_of_fold(df: DataFrame, columns: list[str], learner: Callable[[], Estimator], fold_col: str = "fold", k: int = 4, components: int | None = None) -> DataFrame:
    """df with score, each row's probability of label 1 by a model that saw the other
    folds only. Preparation is fitted on these folds as well."""
    parts = []
    for i in range(k):
        model = Pipeline(stages=[*prepared(columns, components), learner()]).fit(df.where(F.col(fold_col) != i))
        parts.append(model.transform(df.where(F.col(fold_col) == i)).select(*df.columns, vector_to_array("probability")[1].alias("score")))
    return reduce(DataFrame.unionByName, parts)


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score, numBins=0).evaluate(scored.withColumn(score, F.col(score).cast("double")))


def auc_by(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """by, auc: the chance that a row of label 1 scores above one of label 0, ties counting
    half. From counts by score: a window holds a row a distinct score."""
    counts = rows.groupBy(*by, score).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    return counts.withColumn("won", won).groupBy(*by).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def jitter(value: float, rng: random.Random, by: float = 0.1) -> float:
    """value moved by up to `by` of it, either way."""
    return value * (1 + rng.uniform(-by, by))


def draw_columns(groups: dict[str, list[str]], rng: random.Random, k: int = 1, always: tuple[str, ...] = (), keep: float = 1.0) -> list[str]:
    """The columns of k groups drawn without replacement, each kept with a chance of
    `keep`, after those that are always there: a learner's random subspace."""
    drawn = [g for g in rng.sample(sorted(groups), k) if rng.random() < keep]
    return [*always, *[c for g in drawn for c in groups[g]]]


def subspace_scores(df: DataFrame, key: str, groups: dict[str, list[str]], learner: Callable[[random.Random], Estimator], runs: int = 3, drawn: int = 2, seed: int = 42, k: int = 3, at_once: int = 4) -> DataFrame:
    """df (key, label, fold, columns) with score: the mean of out-of-fold scores of `runs`
    learners that each see a few random groups of columns. Columns, nulls filled with
    medians, are assembled and stored once; learners see slices of the vector, some fitted at once."""
    rng, columns = random.Random(seed), sorted({c for g in groups.values() for c in g})
    filled = [f"_{c}" for c in columns]
    stages = [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="all_features")]
    rows = kept(Pipeline(stages=stages).fit(df).transform(df).select(key, "label", "fold", "all_features"), "assembled")
    jobs = []
    for _ in range(runs):
        own = VectorSlicer(inputCol="all_features", outputCol="features", indices=[columns.index(c) for c in draw_columns(groups, rng, drawn)])
        made = learner(rng)
        jobs += [(own, made, i) for i in range(k)]

    def scored(job):
        own, made, i = job
        model = made.fit(own.transform(rows.where(F.col("fold") != i)))
        return model.transform(own.transform(rows.where(F.col("fold") == i))).select(key, vector_to_array("probability")[1].alias("score"))

    with ThreadPool(at_once) as pool:
        parts = pool.map(scored, jobs)
    return df.join(reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.avg("score").alias("score")), key)


def tree_scores(df: DataFrame, columns: list[str], trees: ExtraTrees, k: int = 3) -> DataFrame:
    """df (label, fold, columns without nulls) with score by extremely randomised trees of the
    other folds. df should be stored."""
    parts = [trees.fit(df.where(F.col("fold") != i), columns).transform(df.where(F.col("fold") == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def signed_terms(rows: DataFrame, key: str, words: Column, label: str, c: float, min_df: int = 5, **how) -> DataFrame:
    """term, coefficient: those that a linear learner with an L1 penalty leaves, over which of
    the words in min_df rows or more a row has. No vocabulary is collected, and none cut."""
    own = kept(rows.select(key, F.explode(F.array_distinct(words)).alias("term")), "row-terms")
    often = own.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).select("term")
    labels = rows.select(F.lit(0).alias("model"), key, F.col(label).alias("label"))
    found = sparse.svm(own.join(often, "term").select(key, "term", F.lit(1.0).alias("value")), labels, key, c, **how)
    return found.where(F.col("term") != sparse.INTERCEPT).select("term", F.col("w").alias("coefficient"))


def signed_counts(items: DataFrame, key: str, words: Column, terms: DataFrame) -> DataFrame:
    """key, positive, negative: how many of an item's distinct words have a coefficient of
    either sign; 0 without words."""
    own = items.select(key, F.explode(F.array_distinct(words)).alias("term")).join(terms, "term")
    sign = lambda c: F.count(F.when(c, 1))
    counts = own.groupBy(key).agg(sign(F.col("coefficient") > 0).alias("positive"), sign(F.col("coefficient") < 0).alias("negative"))
    return items.select(key).join(counts, key, "left").na.fill(0, ["positive", "negative"])
