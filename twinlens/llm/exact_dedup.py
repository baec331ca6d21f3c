"""Exact deduplication by Grace hashing.

Each scan task collapses its copies: a text leaves the task once, with how many rows
have it and the first of them, and later batches of the task send only its digest; the
rows' ids stay behind in a stored table. Records are dealt to buckets by a hash; buckets
measured as too large are written again as spill tables and partitioned by the next
seeded hash, as often as needed. Each bucket then fits one open-addressing table (a
dict) that compares complete contents. A bucket that is too large by the copies of one
text, sent by many tasks, is thinned in parts first. What the tables decide, a row a
text, is joined with the stored ids by the text's digest, where Spark splits hot texts.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS, stored

BUCKET_BYTES = 16 << 20
#: Buckets at least, so that a small input still spreads over the executors.
MIN_BUCKETS = 48
_LEVELS = 8
#: Digests that a scan task remembers as sent; beyond, texts may be sent again.
SENT = 1 << 18

_RECORD = pa.schema([("h", pa.int64()), ("sha", pa.binary()), ("text", pa.string()), ("n_bytes", pa.int64()), ("task", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("loc", pa.int64()), ("n", pa.int64())])
_RECORD_DDL = "h long, sha binary, text string, n_bytes long, task long, none boolean, id long, loc long, n long"
_LOCAL = _RECORD.append(pa.field("ids", pa.list_(pa.int64())))
_CLASS_DDL = "sha binary, id long, loc long, n long"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " ")


def _firsts(group: np.ndarray, groups: int, none: np.ndarray, value: np.ndarray, loc: np.ndarray) -> np.ndarray:
    """The row of each group with the least id (none last), then the least place."""
    order = np.lexsort((loc, value, none, group))
    return order[np.searchsorted(group[order], np.arange(groups))]


def _collapse(batches):
    """Rows (text, id) as records with the list of their ids."""
    task, sent, rows = TaskContext.get().partitionId(), set(), 0
    for b in batches:
        g = pa.Table.from_batches([b]).group_by("text").aggregate([("id", "list")]).combine_chunks()
        if not g.num_rows:
            continue
        texts, ids = g["text"].chunk(0), g["id_list"].chunk(0)
        n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten()
        none, value = flat.is_null().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False)
        loc = (task << 33) + rows + np.arange(len(value))
        first = _firsts(np.repeat(np.arange(len(n)), n), len(n), none, value, loc)
        sha, shown = [], []
        for x in texts.to_pylist():
            d = hashlib.sha256(x.encode()).digest()
            sha.append(d)
            shown.append(None if d in sent else x)
            sent.add(d)
        if len(sent) > SENT:
            sent.clear()
        size = np.where([x is None for x in shown], -1, pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
        h = np.frombuffer(b"".join(x[:8] for x in sha), ">i8").astype(np.int64)
        start = (task << 33) + rows + np.cumsum(n) - n  # the place of the list's first id
        rows += len(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(sha, pa.binary()), pa.array(shown, pa.string()), pa.array(size, pa.int64()), pa.array(start), pa.array(none[first]), pa.array(value[first]), pa.array(loc[first]), pa.array(n), ids.cast(pa.list_(pa.int64()))],
            schema=_LOCAL,
        )


def _classes(t: pa.Table):
    """(class of each row, a row of each class that has its text) by complete contents."""
    number: dict[str, int] = {}
    of_sha, group, shown = {}, np.zeros(t.num_rows, np.int64), []
    sha, text = t["sha"].to_pylist(), t["text"].to_pylist()
    for i, x in enumerate(text):
        if x is not None:
            if x not in number:
                number[x] = len(number)
                shown.append(i)
            group[i] = of_sha[sha[i]] = number[x]
    for i, x in enumerate(text):
        if x is None:  # the task sent the text before, so it is in this bucket too
            group[i] = of_sha[sha[i]]
    return group, shown


def _decided(t: pa.Table):
    group, shown = _classes(t)
    none, value, loc = (t[c].to_numpy(zero_copy_only=False) for c in ("none", "id", "loc"))
    first = _firsts(group, len(shown), none, value, loc)
    n = np.bincount(group, t["n"].to_numpy(), len(shown)).astype(np.int64)
    return shown, none[first], value[first], loc[first], n


def _bucket(t: pa.Table) -> pa.Table:
    """The classes of a bucket's records: digest, first id and its place, rows."""
    shown, none, value, loc, n = _decided(t)
    return pa.table({"sha": t["sha"].take(pa.array(shown, pa.int64())), "id": pa.array(value, pa.int64(), mask=none), "loc": loc, "n": n})


def _thin(t: pa.Table) -> pa.Table:
    """Records of equal texts as one record each."""
    shown, none, value, loc, n = _decided(t)
    kept = t.select(_RECORD.names).take(pa.array(shown, pa.int64()))
    for name, column in (("none", none), ("id", value), ("loc", loc), ("n", n)):
        kept = kept.set_column(kept.schema.get_field_index(name), name, pa.array(column))
    return kept.cast(_RECORD)


def _resolved(records: DataFrame, bucket_bytes: int) -> DataFrame:
    """The classes of all records. Of the buckets, only their number and whether any is
    too large come to the driver."""
    done = []
    for level in range(_LEVELS):
        total = records.agg(F.sum(F.greatest("n_bytes", F.lit(0)))).first()[0] or 0
        n = max(2 if level else MIN_BUCKETS, math.ceil(total / bucket_bytes))
        keyed = records.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(n)))
        sizes = keyed.where("n_bytes >= 0").groupBy("bucket").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("texts"), (F.min("h") != F.max("h")).alias("several"))
        over = stored(sizes.where((F.col("bytes") > 2 * bucket_bytes) & (F.col("texts") > 1)), "exact-over")
        last = level == _LEVELS - 1 or over.isEmpty()
        fits = keyed if last else keyed.join(over.select("bucket"), "bucket", "left_anti")
        done.append(fits.groupBy("bucket").applyInArrow(_bucket, _CLASS_DDL))
        if last:
            return reduce(DataFrame.unionByName, done)
        large = keyed.join(over, "bucket")
        parts = F.least(F.ceil(F.col("bytes") / bucket_bytes), F.ceil(F.col("texts") / 2))
        part = F.pmod(F.shiftright("task", 33), parts).alias("part")
        thin = large.where("not several").groupBy("bucket", part).applyInArrow(_thin, _RECORD_DDL)
        records = stored(large.where("several").select(*_RECORD.names).unionByName(thin), "exact-spill")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text: Column | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    `text` is the text compared (default: normalised column `text`). Of equal
    texts the row with the smallest id stays; a null id comes after all others,
    and of repeated rows with one id exactly one stays. Null and empty texts are
    equal. An empty table gives an empty result; other columns are ignored.
    """
    text = normalised(F.col("text")) if text is None else text
    rows = df.select(text.alias("text"), F.col(id_col).cast("long").alias("id"))
    local = stored(rows.mapInArrow(_collapse, f"{_RECORD_DDL}, ids array<long>"), "exact-local")
    classes = _resolved(local.select(*_RECORD.names), bucket_bytes)
    c = classes.select(F.col("sha").alias("_sha"), F.col("id").alias("keep_id"), F.col("loc").alias("keep_loc"), F.col("n").alias("group_size"))
    members = local.select("sha", F.col("task").alias("start"), F.posexplode("ids").alias("pos", "member"))
    out = members.join(c, members["sha"] == c["_sha"])
    return out.select(F.col("member").alias(id_col), "keep_id", "group_size", (F.col("start") + F.col("pos") == F.col("keep_loc")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_documents(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df that stay; ids must be unique."""
    keep = exact_dedup(df, id_col).where("kept").select(id_col)
    return df.join(keep, id_col, "left_semi")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact groups of all documents, whole texts, white space normalised; nulls,
    ties, repeated rows and empty tables as in exact_dedup(), columns other than doc_id
    and text are not read."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
