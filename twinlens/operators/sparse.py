"""Linear learners over sparse rows in long form, (key, term, value), with weights as a
table: neither the rows' vectors nor the weights pass through the driver.

svm() minimises the sum of |w| plus c times the sum of squared hinge losses, the intercept's
weight included, to its minimum by Newton steps. Rows are packed once, in chunks that hold all
terms of theirs: a step sends each chunk the weights of its terms that have one, and the chunk's
sums of the gradient back, so that what is shuffled follows the vocabulary and not the entries.
All folds' learners take their steps together. A step moves the terms that are furthest from
their optimum, BLOCK a model: their curvature is summed over chunks, and is what the driver holds.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept

#: The term of the intercept: each row has it with the value 1.
INTERCEPT = ""
#: Entries of a chunk, about; terms of a model that a step moves at most, others wait for a later one.
ENTRIES, BLOCK = 1 << 18, 1 << 10
#: In place of a term's number: the sum of a model's losses.
_LOSS = -1


def with_intercept(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """rows (key, term, value) of the items, and an intercept for each of these."""
    own = rows.join(items.select(key).distinct(), key, "left_semi").select(key, "term", F.col("value").cast("double").alias("value"))
    return own.unionByName(items.select(key).distinct().select(key, F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias("value")))


_PACKED = "chunk int, models array<int>, size int, ids array<bigint>, entries binary"


def _packed(batches):
    """A row a chunk: its distinct terms, and its entries (row, code, value) and the sign of each row
    in each model (0: not in it), compressed: readers hold a file's chunks at once."""
    now, parts = None, []

    def out():
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        signs = b.filter(b.column(4).is_valid())
        rows = b.filter(b.column(2).is_valid())
        keys = pc.unique(signs.column(1))
        models, at = np.unique(signs.column(4).to_numpy(), return_inverse=True)
        y = np.zeros((len(models), len(keys)))
        y[at, pc.index_in(signs.column(1), keys).to_numpy()] = signs.column(5).to_numpy()
        row = pc.index_in(rows.column(1), keys).to_numpy()
        ids, code = np.unique(rows.column(2).to_numpy(), return_inverse=True)
        value = rows.column(3).to_numpy()
        by = np.lexsort((code, row))
        blob = b"".join(x.tobytes() for x in (value[by], y, row[by].astype(np.int32), code[by].astype(np.int32)))
        lists = [pa.array([x], pa.list_(t)) for x, t in ((models.astype(np.int32), pa.int32()), (ids, pa.int64()))]
        columns = [pa.array([now], pa.int32()), lists[0], pa.array([len(keys)], pa.int32()), *lists[1:], pa.array([len(row).to_bytes(4, "little") + pa.compress(blob, "zstd", asbytes=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PACKED.split(", ")])

    for b in batches:
        chunks = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
        for x, z in zip(cuts, cuts[1:]):
            if now != chunks[x] and parts:
                yield out()
                parts = []
            now = int(chunks[x])
            parts.append(b.slice(x, z - x))
    if parts:
        yield out()


def _chunks(batches):
    """Of each packed chunk: its models, ids, entries (row, code, value), signs and margins."""
    for b in batches:
        for k in range(b.num_rows):
            get = lambda n: b.column(n)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            models, ids, size, blob = get("models"), get("ids"), b.column("size")[k].as_py(), b.column("entries")[k].as_py()
            n, signs = int.from_bytes(blob[:4], "little"), len(models) * size
            raw = np.frombuffer(pa.decompress(blob[4:], 16 * n + 8 * signs, "zstd", asbytes=True), np.uint8)
            value, y = raw[: 8 * n].view(float), raw[8 * n : 8 * (n + signs)].view(float).reshape(len(models), size)
            row, code = raw[8 * (n + signs) :].view(np.int32).reshape(2, n)
            w = np.zeros((len(models), len(ids)))
            here = np.isin(get("w_model"), models)  # a chunk may have no row of some model
            w[np.searchsorted(models, get("w_model")[here]), np.searchsorted(ids, get("w_id")[here])] = get("w_w")[here]
            yield models, ids, row, code, value, y, np.array([np.bincount(row, value * v[code], size) for v in w])


def _gradients(c: float):
    def run(batches):
        for models, ids, row, code, value, y, margin in _chunks(batches):
            for m, s, at in zip(models, y, margin):
                # rows that are far enough on their side do not pull
                short = np.abs(s) * np.maximum(0.0, 1.0 - s * at)
                g = np.bincount(code, value * (-2.0 * c * s * short)[row], len(ids))
                hit = np.flatnonzero(g)
                numbers, sums = np.r_[_LOSS, ids[hit]], np.r_[c * short @ short, g[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), m, np.int32)), pa.array(numbers), pa.array(sums)], names=["model", "id", "g"])

    return run


def _curvatures(c: float, moving: dict[int, np.ndarray]):
    """model, at, h: second derivatives of the losses by the moving terms (ids in order) of each model,
    a row a term, summed over a task's chunks."""

    def run(batches):
        total = {m: np.zeros((len(x), len(x))) for m, x in moving.items()}
        for models, ids, row, code, value, y, margin in _chunks(batches):
            for m, s, at in zip(models.tolist(), y, margin):
                if m not in moving:
                    continue
                place = np.searchsorted(moving[m], ids)
                place[moving[m][np.minimum(place, len(moving[m]) - 1)] != ids] = -1
                use = (place[code] >= 0) & ((s != 0) & (s * at < 1.0))[row]
                rows, own = np.unique(row[use], return_inverse=True)
                for k in range(0, len(rows), 4096):
                    part = (own >= k) & (own < k + 4096)
                    x = np.zeros((min(4096, len(rows) - k), len(moving[m])))
                    x[own[part] - k, place[code[use][part]]] = value[use][part]
                    total[m] += 2.0 * c * x.T @ x
        for m, h in total.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * len(h)), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), m, np.int32)), pa.array(np.arange(len(h), dtype=np.int32)), lists], names=["model", "at", "h"])

    return run


def _added(batches):
    """Rows (model, at, h) of a (model, at) follow each other: their sums."""
    now, total = None, None
    for b in batches:
        for m, at, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if now == (m, at):
                total = total + h.values.to_numpy()
                continue
            if now is not None:
                yield pa.RecordBatch.from_pylist([{"model": now[0], "at": now[1], "h": total.tolist()}], _ADDED)
            now, total = (m, at), h.values.to_numpy()
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"model": now[0], "at": now[1], "h": total.tolist()}], _ADDED)


_ADDED = pa.schema([("model", pa.int32()), ("at", pa.int32()), ("h", pa.list_(pa.float64()))])


def _newton(h: np.ndarray, g: np.ndarray, w: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """d that about minimises g d + d h d / 2 + |w + d|, by coordinates; those that are 0 wait for sweeps
    over all. The next step has what is left."""
    # no two weights of terms that are always together are told apart by the losses
    curve = np.diag(h) + 1e-12 + 1e-9 * np.diag(h).max(initial=0.0)
    d, slope, every = np.zeros(len(w)), g.copy(), True
    for k in range(sweeps):
        most = 0.0
        for j in range(len(w)) if every else np.flatnonzero(w + d).tolist():
            at = w[j] + d[j]
            move = at - slope[j] / curve[j]
            by = np.sign(move) * max(abs(move) - 1.0 / curve[j], 0.0) - at
            if by:
                d[j] += by
                slope += by * h[j]
                most = max(most, abs(by))
        if most <= 1e-9 + 1e-3 * np.abs(d).max(initial=0.0):
            if every:
                break
            every = True
        else:
            every = False
        if k % 50 == 49 and not every:
            d = _ahead(h, g, w, d)
            slope = g + h @ d
    return d


def _ahead(h: np.ndarray, g: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d moved towards the minimum over what is not 0, as far as no weight changes its sign."""
    free = np.flatnonzero(w + d)
    at = (w + d)[free]
    by = np.linalg.lstsq(h[np.ix_(free, free)], -(g + h @ d)[free] - np.sign(at), rcond=1e-12)[0]
    meets = by * at < 0
    far = min(1.0, (-at[meets] / by[meets]).min(initial=1.0))
    d = d.copy()
    d[free] += far * by
    if far < 1.0:
        stops = free[meets][np.isclose(-at[meets] / by[meets], far, rtol=1e-9)]
        d[stops] = -w[stops]
    return d


def svm(rows: DataFrame, labels: DataFrame, key: str, c: float, rounds: int = 200, tolerance: float = 1e-5, entries: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """model, term, w: L1-penalised learners, INTERCEPT among the terms; those whose weight is 0
    are left out. rows: key, term, value, one a term; labels: model, key, label (1 or anything
    else), one row a model that the item is to train. Rows without a label take no part; no labels
    give no weights.

    Steps that do not lessen a model's sum are halved until they do. Ends when a step would move no
    weight by more than tolerance, with a warning if `rounds` steps were not enough for that.
    """
    spark = rows.sparkSession
    own = kept(with_intercept(rows, labels, key), "svm-rows")
    ids = kept(own.select("term").distinct().withColumn("_id", F.monotonically_increasing_id()), "svm-terms")
    chunk = F.pmod(F.xxhash64(key), F.lit(-(-max(own.count(), 1) // entries))).cast("int").alias("chunk")
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    signs = labels.select(chunk, key, none("id", "long"), none("value", "double"), F.col("model").cast("int").alias("model"), F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y"))
    every = own.join(ids.hint("merge"), "term").select(chunk, key, "_id", "value", none("model", "int"), none("y", "double")).union(signs)
    packed = kept(every.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_packed, _PACKED), "svm-chunks")
    terms = packed.select("chunk", F.explode("ids").alias("id"))

    def with_weights(weights):
        sent = terms.join(weights.hint("merge"), "id").groupBy("chunk").agg(*[F.collect_list(n).alias(f"w_{n}") for n in ("model", "id", "w")])
        lists = [F.coalesce(F.col(f"w_{n}"), F.array().cast(f"array<{t}>")).alias(f"w_{n}") for n, t in (("model", "int"), ("id", "bigint"), ("w", "double"))]
        return packed.join(sent.hint("merge"), "chunk", "left").select(*packed.columns, *lists)

    def weighed(weights):
        """Stored gradients and weights of all terms, and each model's sum."""
        found = with_weights(weights).mapInArrow(_gradients(c), "model int, id long, g double").groupBy("model", "id").agg(F.sum("g").alias("g"))
        found = kept(found.join(weights.hint("merge"), ["model", "id"], "full").na.fill(0.0, ["g", "w"]), "svm-weights")
        total = found.groupBy("model").agg(F.sum(F.when(F.col("id") == _LOSS, F.col("g")).otherwise(F.abs("w"))).alias("x"))
        return found, {r.model: r.x for r in total.collect()}

    now, sums = weighed(spark.createDataFrame([], "model int, id long, w double"))
    for _ in range(rounds):
        # how far the sum falls with a weight, per unit
        off = F.when(F.col("w") == 0, F.greatest(F.abs("g") - 1.0, F.lit(0.0))).otherwise(F.abs(F.col("g") + F.signum("w")))
        known = now.where(F.col("id") != _LOSS).withColumn("off", off).where("off > 0")
        first = Window.partitionBy("model").orderBy(F.desc("off"), "id")
        chosen = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= block).orderBy("model", "id").select("model", "id", "g", "w").toPandas()
        moving = {int(m): x for m, x in chosen.groupby("model")}
        if not moving:
            break
        curved = with_weights(now.where("w <> 0").select("model", "id", "w")).mapInArrow(_curvatures(c, {m: x["id"].to_numpy() for m, x in moving.items()}), "model int, at int, h array<double>")
        curved = curved.repartition("model", "at").sortWithinPartitions("model", "at").mapInArrow(_added, "model int, at int, h array<double>").toArrow().sort_by([("model", "ascending"), ("at", "ascending")])
        steps = {}
        for m, x in moving.items():
            h = curved.filter(pc.equal(curved["model"], m))["h"].combine_chunks().flatten().to_numpy().reshape(len(x), len(x))
            steps[m] = _newton(h, x["g"].to_numpy(), x["w"].to_numpy())
        fall = {m: float(moving[m]["g"] @ d + np.abs(moving[m]["w"] + d).sum() - np.abs(moving[m]["w"]).sum()) for m, d in steps.items()}
        share, waits = dict.fromkeys(steps, 1.0), {m for m, d in steps.items() if np.abs(d).max() > tolerance}
        if not waits:
            break
        while True:
            new = [(m, int(i), float(share[m] * by)) for m, d in steps.items() for i, by in zip(moving[m]["id"], d) if by]
            by = spark.createDataFrame(new, "model int, id long, by double")
            weights = now.select("model", "id", "w").where("w <> 0").join(by, ["model", "id"], "full").select("model", "id", (F.coalesce("w", F.lit(0.0)) + F.coalesce("by", F.lit(0.0))).alias("w")).where("abs(w) > 1e-14")
            then, less = weighed(weights)
            up = {m for m in steps if share[m] and less.get(m, 0.0) > sums[m] + 1e-4 * share[m] * fall[m] + 1e-12 * abs(sums[m])}
            if not up:
                break
            share |= {m: share[m] / 2 if share[m] > 1e-6 else 0.0 for m in up}
        now, sums = then, less
        if not any(np.abs(share[m] * steps[m]).max() > tolerance for m in steps):
            break
    else:
        warnings.warn(f"weights still moved after {rounds} steps", stacklevel=2)
    return now.where(F.col("w") != 0).join(ids.withColumnRenamed("_id", "id").hint("merge"), "id").select("model", "term", "w")


def margins(rows: DataFrame, items: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """items (model, key, ...) with margin, by their model's weights; 0 without known terms."""
    found = with_intercept(rows, items, key).join(items.select("model", key), key).join(weights, ["model", "term"])
    return items.join(found.groupBy("model", key).agg(F.sum(F.col("value") * F.col("w")).alias("margin")), ["model", key], "left").fillna(0.0, ["margin"])


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def out_of_fold(rows: DataFrame, items: DataFrame, key: str, c: float, folds: int = 4, **how) -> DataFrame:
    """items (key, label, fold) with score: labelled ones by a learner of the other folds,
    those with a null label by a learner of all labelled ones."""
    known = items.where("label is not null")
    models = F.array(*[F.when(F.col("fold") != k, k) for k in range(folds)], F.lit(-1))
    labels = known.select(key, "label", F.explode(F.array_compact(models)).alias("model"))
    weights = svm(rows, labels, key, c, **how)
    asked = items.withColumn("model", F.when(F.col("label").isNull(), -1).otherwise(F.col("fold")))
    return margins(rows, asked, weights, key).withColumn("score", sigmoid(F.col("margin"))).drop("margin", "model")
