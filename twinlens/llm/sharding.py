"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records uniformly: rendezvous hashing of the key picks the
shard (the greatest of one seeded hash a shard), and a seeded hash of the whole record
picks one of the shard's memory-sized buckets. Pass two shuffles each bucket with
Spark's shuffle(), a Fisher-Yates shuffle of an array, and numbers its rows after
those of the shard's earlier buckets. A shard is the concatenation of its shuffled
buckets, a uniform permutation because the scatter is uniform.

A task holds a range of shards and buckets by arithmetic, not by sampled bounds, and
shuffles its buckets in their order, each from its sorted rows: so a repeated run or a
repeated task draws the same permutation, and shards are written without another
shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, quoted

BUCKET_BYTES = 8 << 20
#: Bytes of records that a task shuffles and writes, about.
TASK_BYTES = 64 << 20


def shard_of(key: Column, n_shards: int, seed: int = 0) -> Column:
    """Shard by key and shard count alone; with one more shard, rows move only
    into the new one."""
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.struct(F.xxhash64(key, F.lit(seed), i).alias("h"), i.alias("shard")),
    )
    return F.array_max(drawn)["shard"]


def shuffle_shards(df: DataFrame, key: str, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, record_bytes: Column | None = None) -> DataFrame:
    """df's rows with shard, grown_shard and a gapless slot in the shard.

    The columns of df must be orderable and hashable (no maps) and not be named shard,
    slot or grown_shard (a ValueError); select what the shards are to hold before the
    call. `record_bytes` is a row's size for sizing the buckets (default 64). Null keys
    share one shard, as do rows with equal keys, which the key law asks for; inside the
    shard their bucket follows from the whole row, so they spread over its buckets. Only
    rows equal in every column, which nothing tells apart, share a bucket. Every row gets
    one slot, repeated rows included. An empty table gives an empty one.
    """
    if taken := {"shard", "slot", "grown_shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} are named as the result's")
    size = F.lit(64) if record_bytes is None else record_bytes
    total = df.agg(F.sum(size)).first()[0] or 0
    n_buckets = max(2, math.ceil(total / n_shards / bucket_bytes))
    n_tasks = min(n_shards * n_buckets, max(n_shards, math.ceil(total / TASK_BYTES)))
    k = F.col(quoted(key))
    row = F.struct(*map(quoted, df.columns))
    bucket = F.pmod(F.xxhash64(row, F.lit(seed), F.lit("bucket")), F.lit(n_buckets))
    placed = df.select(row.alias("row"), shard_of(k, n_shards, seed).alias("shard"), bucket.alias("bucket"))
    at = F.col("shard").cast("long") * n_buckets + F.col("bucket")
    task = F.floor(at * n_tasks / F.lit(n_shards * n_buckets)).cast("int")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.lit(None).cast(placed.schema["row"].dataType).alias("row"), "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # a bucket's start travels with its rows, as a record without a row: no join, no broadcast
    rows = placed.withColumn("start", F.lit(None).cast("long")).unionByName(starts)
    scattered = rows.withColumn("task", task).repartitionById(n_tasks, F.col("task"))
    # sorted first, so that the order before the shuffle does not depend on how tasks ended
    buckets = scattered.groupBy("task", "shard", "bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.max("start").alias("start"))
    shuffled = buckets.sortWithinPartitions("shard", "bucket").select("shard", "start", F.shuffle("rows", F.lit(seed)).alias("rows"))
    dealt = shuffled.select("shard", "start", F.posexplode("rows").alias("pos", "row"))
    out = dealt.select("row.*", "shard", (F.col("start") + F.col("pos")).alias("slot"))
    newcomer = F.xxhash64(k, F.lit(seed), F.lit(n_shards)) > F.xxhash64(k, F.lit(seed), F.col("shard"))
    return out.withColumn("grown_shard", F.when(newcomer, F.lit(n_shards)).otherwise(F.col("shard")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes shuffle_shards() output as Parquet, a folder a shard, each file in
    slot order and with a range of the slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in shards 0 to 23 by the `key` law: written as Parquet
    shards to the shared folder and read back from there, every column of the result
    taken from what is read. A null text has size 8 and the checksum of no bytes;
    repeated rows have a slot each; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = shuffle_shards(docs, "doc_id", 24, seed=2, record_bytes=F.octet_length(text) + 64)
    path = new_path(spark, "shards")
    write_shards(out, path)
    back = spark.read.schema(out.schema).parquet(path)
    return back.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
