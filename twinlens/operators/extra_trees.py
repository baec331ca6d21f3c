"""Extremely randomised trees, grown a level at a time.

Each open node draws some features and, for each, one threshold between the least and the
largest value that its rows have; the best of these splits it. A level is two passes over the
rows, all trees and nodes at once: ranges of the drawn features, then counts by side and
label. Tasks add up what they have of a node first, so what is shuffled and what the driver
gets is the size of a level: nodes times drawn features, bounded by trees, depth and leaf size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _impurity(pos: np.ndarray, n: np.ndarray, entropy: bool) -> np.ndarray:
    p = pos / np.maximum(n, 1)
    if not entropy:
        return 2 * p * (1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.nan_to_num(p * np.log2(p)) - np.nan_to_num((1 - p) * np.log2(1 - p))


@dataclass
class Tree:
    """Nodes in order of growth: feature (-1: a leaf), threshold, left child (the right one
    follows it) and share of label 1."""

    feature: list = field(default_factory=lambda: [-1])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    share: list = field(default_factory=lambda: [0.5])

    def arrays(self):
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.share)


def _places(x: np.ndarray, arrays) -> np.ndarray:
    """The node where each row ends."""
    feature, threshold, left, _ = arrays
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        r = rows[inner]
        at[r] = left[at[r]] + (x[r, feature[at[r]]] > threshold[at[r]])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class ExtraTrees:
    """trees, depth and the least number of rows of a leaf bound the model; drawn: features drawn
    by a node (None: the root of their number). The same seed and rows give the same trees,
    however the rows are dealt."""

    trees: int = 160
    depth: int = 12
    leaf: int = 2
    drawn: int | None = None
    entropy: bool = True
    seed: int = 42

    def fit(self, df: DataFrame, columns: list[str], label: str = "label") -> "ExtraTreesModel":
        """df: label 1 or 0, and numbers without nulls. Rows should be stored: each level reads
        them twice. No rows give leaves of 0.5."""
        rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"))
        spark, forest = df.sparkSession, [Tree() for _ in range(self.trees)]
        drawn = self.drawn or max(1, round(len(columns) ** 0.5))
        opened = {(t, 0) for t in range(self.trees)}
        for _ in range(self.depth):
            if not opened:
                break
            asked = {}
            for t, node in sorted(opened):
                rng = np.random.default_rng([self.seed, t, node])
                asked[t, node] = (rng.permutation(len(columns))[: min(drawn, len(columns))], rng.random(min(drawn, len(columns))))
            state = spark.sparkContext.broadcast(([x.arrays() for x in forest], {k: v[0] for k, v in asked.items()}))
            ranges = rows.mapInArrow(lambda b: _ranges(b, *state.value), "t int, node int, f int, low double, high double")
            ranges = ranges.groupBy("t", "node", "f").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
            cuts = {}
            for t, node, f, low, high in ranges.itertuples(index=False):
                features, draws = asked[t, node]
                u = draws[list(features).index(f)]
                if high > low:
                    cuts.setdefault((t, node), []).append((f, low + u * (high - low)))
            sent = spark.sparkContext.broadcast(([x.arrays() for x in forest], {k: cuts.get(k, []) for k in asked}))
            counts = rows.mapInArrow(lambda b: _counts(b, *sent.value), "t int, node int, f int, n double, pos double, n_left double, pos_left double")
            counts = counts.groupBy("t", "node", "f").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "n_left", "pos_left")]).toPandas()
            state.unpersist(), sent.unpersist()
            opened = self._split(forest, cuts, counts)
        return ExtraTreesModel([x.arrays() for x in forest], columns)

    def _split(self, forest: list[Tree], cuts: dict, counts) -> set:
        opened = set()
        for (t, node), found in counts.groupby(["t", "node"]):
            tree, all_ = forest[t], found[found.f == -1].iloc[0]
            tree.share[node] = all_.pos / all_.n
            options = found[found.f >= 0].sort_values("f")
            n_right = options.n - options.n_left
            gain = all_.n * _impurity(np.array([all_.pos]), np.array([all_.n]), self.entropy)[0]
            gain = gain - options.n_left * _impurity(options.pos_left, options.n_left, self.entropy) - n_right * _impurity(options.pos - options.pos_left, n_right, self.entropy)
            gain = gain.where((options.n_left >= self.leaf) & (n_right >= self.leaf), -1.0)
            if not len(gain) or gain.max() <= 1e-12:
                continue
            best = options.loc[gain.idxmax()]
            tree.feature[node], tree.threshold[node], tree.left[node] = int(best.f), dict(cuts[t, node])[best.f], len(tree.feature)
            for n, pos in ((best.n_left, best.pos_left), (best.n - best.n_left, best.pos - best.pos_left)):
                if n >= 2 * self.leaf and 0 < pos < n:
                    opened.add((t, len(tree.feature)))
                tree.feature.append(-1), tree.threshold.append(0.0), tree.left.append(0), tree.share.append(pos / n)
        return opened


def _open_rows(x, forest, asked):
    """((tree, node), what is asked of it, its rows) for the open nodes that have any."""
    for t, arrays in enumerate(forest):
        nodes = [n for u, n in asked if u == t]
        if nodes:
            at = _places(x, arrays)
            for node in nodes:
                own = np.flatnonzero(at == node)
                if len(own):
                    yield (t, node), asked[t, node], own


def _ranges(batches, forest, asked):
    low, high = {}, {}
    for b in batches:
        x = _matrix(b.column(0))
        for key, features, own in _open_rows(x, forest, asked):
            part = x[np.ix_(own, features)]
            low[key] = np.minimum(low.get(key, np.inf), part.min(0))
            high[key] = np.maximum(high.get(key, -np.inf), part.max(0))
    rows = [(*key, int(f), float(a), float(z)) for key in low for f, a, z in zip(asked[key], low[key], high[key])]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["t", "node", "f", "low", "high"])


def _counts(batches, forest, cuts):
    sums = {}
    for b in batches:
        x, y = _matrix(b.column(0)), b.column(1).to_numpy()
        for key, options, own in _open_rows(x, forest, cuts):
            for f, cut in [(-1, np.inf), *options]:
                left = own if f < 0 else own[x[own, f] <= cut]
                sums[*key, f] = sums.get((*key, f), 0) + np.array([len(own), y[own].sum(), len(left), y[left].sum()])
    if sums:
        keys, values = list(zip(*sums)), np.array(list(sums.values())).T
        yield pa.RecordBatch.from_arrays([*(pa.array(list(map(int, k)), pa.int32()) for k in keys), *map(pa.array, values)], names=["t", "node", "f", "n", "pos", "n_left", "pos_left"])


@dataclass(frozen=True)
class ExtraTreesModel:
    forest: list
    columns: list[str]

    def transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        """df with the mean share of label 1 of the leaves where a row ends."""
        sent = df.sparkSession.sparkContext.broadcast(self.forest)

        @F.arrow_udf("double")
        def mean(column: pa.Array) -> pa.Array:
            x = _matrix(column)
            return pa.array(sum(a[3][_places(x, a)] for a in sent.value) / len(sent.value))

        return df.withColumn(score, mean(F.array(*[F.col(c).cast("double") for c in self.columns])))
