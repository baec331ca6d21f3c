"""Shared folder, stored intermediates and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, as a Java and as a Python class.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\f\r"

_CHUNK = 1 << 20  # bytes hashed at once; a longer text goes alone
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
_made: ContextVar[list | None] = ContextVar("made", default=None)

#: While a table is written: its shuffles' files go when the write ends (the table is
#: whole, so nobody reads them again), and sorted runs keep their order and buckets.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # in Spark 4.1.2 an aggregate trusts a union of equally bucketed tables to be dealt alike,
    # which generated code does not do
    "spark.sql.unionOutputPartitioning": "false",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the
    session sets none, local runs get a temporary one; on several machines that would
    lose rows silently, so there it is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def make_dir(spark: SparkSession, path: str) -> None:
    fs, path = _file_system(spark, path)
    fs.mkdirs(path)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, path = _file_system(spark, path)
    fs.delete(path, True)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def tables_made():
    """A list that gets every table stored meanwhile: what is to be dropped once the results
    are written."""
    made: list[DataFrame] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)


def _noted(df: DataFrame) -> DataFrame:
    if _made.get() is not None:
        _made.get().append(df)
    return df


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and a lost
    executor costs no recomputation of what came before. by: a folder for each value."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _settings(spark, _WRITING):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return _noted(out)


def run_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_run(df: DataFrame, name: str, by: str, order: list[str], part: str | None = None) -> DataFrame:
    """df, which an aggregate or window has dealt by `by`, written as sorted buckets: as
    many as a shuffle has partitions, a file each. Joins and aggregates of runs by `by`
    shuffle nothing, and joins on `order` sort nothing. part: a column with a folder for
    each of its values, each folder sorted."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    with _settings(spark, _WRITING):
        writer = df.write.option("path", path).bucketBy(run_buckets(spark), by).sortBy(*order).format("parquet")
        (writer.partitionBy(part) if part else writer).saveAsTable(table)
    out = spark.table(table)
    out.stored_at, out.stored_as = path, table
    return _noted(out)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables and sorted runs that no later plan reads."""
    for df in tables:
        if "stored_as" in df.__dict__:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
        drop_path(df.sparkSession, df.stored_at)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def word_count(text: Column) -> Column:
    """Number of words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 and so on; kept for a chunk's length, not for longer texts."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _CHUNK + 1), np.uint64(base), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have[: _CHUNK + 1].copy() if n > _CHUNK + 1 else have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_chunks(texts: pa.Array, limit: int = _CHUNK):
    """(first row, offsets, bytes) for runs of whole texts of about `limit` bytes;
    nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield at, off[at : to + 1] - off[at], data[off[at] : off[to]]
        at = to


_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = hash of data[i:j] times base**i."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), len(data)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the spans, their lengths mixed in."""
    n = len(c)
    return mix((c[end] - c[start]) * powers(int(_UNBASE), n)[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long_hash(data: np.ndarray) -> np.uint64:
    """span_hash() of all of data, a piece at a time."""
    total, step = 0, _CHUNK
    for at in range(0, len(data), step):
        piece = (data[at : at + step].astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), min(step, len(data) - at))
        total += int(piece.sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    total += len(data) * 0xD6E8FEB86659FD93
    return mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash() of spans that are in order and do not overlap, with memory for about a
    chunk, however long the text is."""
    if len(data) <= 2 * _CHUNK:
        return span_hash(prefix_hash(data), start, end)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, "right")))
        a, b = start[i], end[j - 1]
        if b - a > 2 * _CHUNK:
            out[i] = _long_hash(data[a:b])
        else:
            out[i:j] = span_hash(prefix_hash(data[a:b]), start[i:j] - a, end[i:j] - a)
        i = j
    return out


def count_by_text(offsets: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text of a chunk, how many of its bytes `counts` (by byte) is true for."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for at in range(0, len(data), _CHUNK):
        c = np.concatenate(([0], np.cumsum(counts[data[at : at + _CHUNK]])))
        near = np.clip(offsets - at, 0, len(c) - 1)
        out += c[near[1:]] - c[near[:-1]]
    return out


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False):
    """(document, start, end, hash) of each word of the texts in a chunk."""
    if lower:
        data = _LOWER[data]
    inside = ~_IS_WS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[-1] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return doc, starts, ends, hash_spans(data, starts, ends)
