"""Hard negatives by exact inner products, pruned in rotated coordinates.

Components are floored to integers, so that a score is an exact integer. An orthogonal
rotation to the principal axes of all rows keeps inner products and moves most of a
vector's length to the front: the product of the leading components, plus or minus the
product of the residual norms (and some slack for rounding), bounds a score. Pairs whose
bounds miss what is asked for go after each few components; the others are verified by
integer products.

Anchors are a stated query set. They are taken in blocks of bounded size, which are
broadcast; each block meets all rows twice: for the positives, then, with their scores
known, for the negatives. A task sends on no more than its best rows for each anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import drop_stored, quoted, stored

#: Bytes of a block's vectors, as integers and rotated.
BLOCK_BYTES = 1 << 25
#: Shares of the components after which bounds are taken.
STAGES = (0.125, 0.25, 0.5)
#: Rounding: a share of the product of two norms, and a part besides.
SLACK, LEAST = 1e-9, 1e-3
#: Pairs, and numbers of a matrix, that a worker holds at once.
PAIRS, NUMBERS = 1 << 16, 1 << 22
_NONE = -(1 << 62)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer vectors, shorter ones with zeros at the end."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _slices(batches, width: int):
    """(ids, labels, vectors) of some rows at a time."""
    step = max(1, NUMBERS // max(width, 1))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width)


def _moments(batches):
    """Sums of products of two components; anchors at (-1, -1), largest sizes at (-2, -2)."""
    total, largest, anchors = np.zeros((0, 0)), 0.0, 0
    for b in batches:
        width = max(len(total), int(b.column(0).value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))
        total = np.pad(total, (0, width - len(total)))
        anchors += b.column(1).true_count
        for at in range(0, b.num_rows, step := max(1, NUMBERS // max(width, 1))):
            x = _matrix(b.column(0).slice(at, step), width).astype(float)
            largest = max(largest, np.abs(x).max(initial=0))
            total += x.T @ x
    i, j = np.triu_indices(len(total))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1, -2]), pa.array(np.r_[j, -1, -2]), pa.array(np.r_[total[i, j], anchors, largest])], names=["i", "j", "x"])


@dataclass
class Rotation:
    """Principal axes of all rows, the longest first; values: what the rows have on each."""

    axes: np.ndarray
    anchors: int
    exact: bool
    values: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, is_anchor: Column) -> "Rotation":
        """The driver gets a matrix of width x width, whatever the number of rows."""
        sums = rows.select("v", is_anchor.alias("anchor")).mapInArrow(_moments, "i long, j long, x double")
        found = sums.groupBy("i", "j").agg(F.when(F.col("i") == -2, F.max("x")).otherwise(F.sum("x")).alias("x")).toPandas()
        i, j, x = found.i.to_numpy(), found.j.to_numpy(), found.x.to_numpy()
        width, largest = max(int(i.max(initial=-1)) + 1, 0), x[i == -2].max(initial=0)
        if width * largest**2 >= 2.0**62:
            raise ValueError("components are too large: an inner product may not fit in 64 bits")
        m, own = np.zeros((width, width)), i >= 0
        m[i[own], j[own]] = m[j[own], i[own]] = x[own]
        values, axes = np.linalg.eigh(m) if width else (np.zeros(0), m)
        return cls(np.ascontiguousarray(axes[:, ::-1]), int(x[i == -1].sum()), width * largest**2 < 2.0**53, values[::-1])

    def cuts(self) -> list[int]:
        width = len(self.axes)
        return [*sorted({max(1, round(width * s)) for s in STAGES if width}), width]


class Rotated:
    """Vectors as integers and on the axes, with norms of what is left after each cut."""

    def __init__(self, q: np.ndarray, r: Rotation):
        self.q, self.z = q, q.astype(float) @ r.axes
        squares = np.cumsum(self.z[:, ::-1] ** 2, 1)[:, ::-1]
        squares = np.concatenate((squares, np.zeros((len(q), 1))), 1)
        self.rest = np.sqrt(np.maximum(squares[:, r.cuts()], 0))
        self.norm = np.sqrt(squares[:, 0])

    def __getitem__(self, which) -> "Rotated":
        out = object.__new__(Rotated)
        out.q, out.z, out.rest, out.norm = self.q[which], self.z[which], self.rest[which], self.norm[which]
        return out


def _scores(a: Rotated, b: Rotated, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer inner products of pairs."""
    out, step = np.empty(len(i), np.int64), max(1, NUMBERS // max(a.q.shape[1], 1))
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("ij,ij->i", a.q[i[at : at + step]], b.q[j[at : at + step]])
    return out


def survivors(a: Rotated, b: Rotated, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, cuts: list[int], seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the wanted pairs, but for some whose score is surely below low[i]
    or above high[i]. seen: gets the numbers of pairs left after each cut."""
    width = cuts[-1]
    first = a.z[:, : cuts[0]] @ b.z[:, : cuts[0]].T
    far = a.rest[:, :1] * b.rest[:, 0] + SLACK * a.norm[:, None] * b.norm + LEAST
    i, j = np.nonzero(wanted & (first + far >= low[:, None]) & (first - far <= high[:, None]))
    part = first[i, j]
    if seen is not None:
        seen[0] = seen.get(0, 0) + int(wanted.sum())
        seen[cuts[0]] = seen.get(cuts[0], 0) + len(i)
    for k, (x, y) in enumerate(zip(cuts, cuts[1:]), 1):
        if y == width or not len(i):
            break
        step = max(1, NUMBERS // (y - x))
        for at in range(0, len(i), step):
            s = slice(at, at + step)
            part[s] += np.einsum("ij,ij->i", a.z[i[s], x:y], b.z[j[s], x:y])
        far = a.rest[i, k] * b.rest[j, k] + SLACK * a.norm[i] * b.norm[j] + LEAST
        keep = (part + far >= low[i]) & (part - far <= high[i])
        i, j, part = i[keep], j[keep], part[keep]
        if seen is not None:
            seen[y] = seen.get(y, 0) + len(i)
    return i, j, _scores(a, b, i, j)


class Best:
    """The k best (score, then the smaller id) of each group so far."""

    def __init__(self, groups: int, k: int):
        self.score, self.id = np.full((groups, k), _NONE), np.full((groups, k), np.iinfo(np.int64).max)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last = self.score[group, -1]
        better = (score > last) | ((score == last) & (ids < self.id[group, -1]))
        group, score, ids = group[better], score[better], ids[better]
        if not len(group):
            return
        k, which = self.score.shape[1], np.unique(group)
        g = np.r_[group, np.repeat(which, k)]
        s, v = np.r_[score, self.score[which].ravel()], np.r_[ids, self.id[which].ravel()]
        by = np.lexsort((v, -s, g))
        g = g[by]
        begin = np.searchsorted(g, which)
        by = by[np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)])) < k]
        self.score[which], self.id[which] = s[by].reshape(-1, k), v[by].reshape(-1, k)

    def rows(self):
        """(group, id, score) of all."""
        g, k = np.nonzero(self.score > _NONE)
        return g, self.id[g, k], self.score[g, k]


@dataclass
class Block:
    """Some anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    rotation: Rotation

    def tiles(self, batches, by_label: bool):
        """(anchors, their places, ids, labels and vectors of rows): few rows at first, so that
        there are scores to beat; by_label: those of one label."""
        cuts, all_anchors = self.rotation.cuts(), Rotated(self.vectors, self.rotation)
        chosen = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels)} if by_label else {None: np.arange(len(self.ids))}
        anchors = {x: all_anchors[at] for x, at in chosen.items()}
        rows_at_once, anchors_at_once = 64, 256
        for ids, labels, q in _slices(batches, cuts[-1]):
            z = Rotated(q, self.rotation)
            for x, places in chosen.items():
                own, at = np.flatnonzero(labels == x) if by_label else np.arange(len(ids)), 0
                while at < len(own):
                    some = own[at : at + rows_at_once]
                    b = z[some]
                    for first in range(0, len(places), anchors_at_once):
                        part = slice(first, first + anchors_at_once)
                        yield anchors[x][part], places[part], ids[some], labels[some], b
                    at += len(some)
                    rows_at_once = min(2 * rows_at_once, PAIRS * 16 // anchors_at_once)

    def positives(self, batches, k: int, seen: dict | None = None) -> Best:
        """Of each anchor: its best rows of the same label but for itself."""
        best, cuts = Best(len(self.ids), k), self.rotation.cuts()
        for a, places, ids, _, b in self.tiles(batches, True):
            other = self.ids[places][:, None] != ids
            i, j, score = survivors(a, b, best.score[places, -1].astype(float), np.full(len(places), np.inf), other, cuts, seen)
            best.add(places[i], score, ids[j])
        return best

    def negatives(self, batches, least: np.ndarray, most: np.ndarray, k: int, seen: dict | None = None) -> Best:
        """Of each anchor and positive: the best rows of other labels with scores from least
        to most (both by anchor and positive; least > most: none)."""
        n, cuts = least.shape[1], self.rotation.cuts()
        best = Best(least.size, k)
        none = least > most
        for a, places, ids, labels, b in self.tiles(batches, False):
            beat = np.maximum(least[places], best.score[:, -1].reshape(-1, n)[places])
            low = np.where(none[places], np.inf, beat).min(1, initial=np.inf)
            high = np.where(none[places], -np.inf, most[places]).max(1, initial=-np.inf)
            i, j, score = survivors(a, b, low, high, self.labels[places][:, None] != labels, cuts, seen)
            for p in range(n):
                fits = (score >= least[places[i], p]) & (score <= most[places[i], p])
                best.add(places[i[fits]] * n + p, score[fits], ids[j[fits]])
        return best


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label (positives): the best rows
    of other labels whose scores are between the given percentages of the positive's.

    Rows with a null id or label, a null vector, or a null or non-finite component take no
    part. Ties go to the smaller id. Shorter vectors count as ending in zeros; an empty vector
    has the score 0 with all. Repeated rows each count as rows, repeated anchors (same id,
    label and vector) once; rows of an anchor's id are never its positives. Vectors whose
    inner products may leave 64 bits are an error. No anchors give no rows.
    """
    spark = df.sparkSession
    v = F.col(quoted(vector_col))
    valid = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(quoted(id_col)).isNotNull() & label.isNotNull() & v.isNotNull() & valid).select(
        F.col(quoted(id_col)).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rotation = Rotation.fit(rows, F.col("anchor"))
    n_blocks = -(-rotation.anchors * max(len(rotation.axes), 1) * 16 // block_bytes)
    found = []
    if n_blocks:
        anchors = rows.where("anchor").drop("anchor").distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
        anchors = stored(anchors, "anchors", by="block")
        for k in range(n_blocks):
            table = anchors.where(F.col("block") == k).orderBy("id", "label").select("id", "label", "v").toArrow()
            if table.num_rows:
                block = Block(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"].combine_chunks(), len(rotation.axes)), rotation)
                found.append(_of_block(spark, rows.drop("anchor"), block, positives, negatives, percent))
        drop_stored(anchors)
    if not found:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*(x.stored_at for x in found))


def _of_block(spark: SparkSession, rows: DataFrame, block: Block, n_pos: int, n_neg: int, percent: tuple[int, int]) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)
    schema = "g long, id long, score long"

    def near(batches):
        yield pa.RecordBatch.from_arrays([*map(pa.array, sent.value.positives(batches, n_pos).rows())], names=["g", "id", "score"])

    # as many rows as the block has anchors, times n_pos
    best = _first(rows.mapInArrow(near, schema), n_pos, "g").toPandas().sort_values(["g", "rank"])
    g, p = best.g.to_numpy(np.int64), best["rank"].to_numpy(np.int64) - 1
    ids, score = np.zeros((len(block.ids), n_pos), np.int64), np.zeros((len(block.ids), n_pos), np.int64)
    least, most = np.ones_like(score), np.zeros_like(score)
    ids[g, p], score[g, p] = best.id, best.score
    # 100 * negative >= low * positive, in integers of any size
    least[g, p] = [-(-percent[0] * x // 100) for x in best.score.tolist()]
    most[g, p] = [percent[1] * x // 100 for x in best.score.tolist()]
    asked = spark.sparkContext.broadcast((ids, score, least, most))

    def hard(batches):
        ids, score, least, most = asked.value
        g, found, s = sent.value.negatives(batches, least, most, n_neg).rows()
        a, p = np.divmod(g, n_pos)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (g, sent.value.ids[a], ids[a, p], score[a, p], found, s))], names=["g", "anchor_id", "positive_id", "positive_score", "id", "score"])

    out = _first(rows.mapInArrow(hard, "g long, anchor_id long, positive_id long, positive_score long, id long, score long"), n_neg, "g")
    out = out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = stored(out, "negatives")
    sent.unpersist(), asked.unpersist()
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 hard negatives for each of the first 5 positives of each anchor: rows
    whose vec_id is divisible by 50; where it is divisible by 7 the label moves on by one.
    Nulls, ties, repeated rows and empty tables as mine_hard_negatives(); other columns are
    not read."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0, label)


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
