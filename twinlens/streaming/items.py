"""Item transforms on streams: new files in, cleaned items and windowed counts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import contact, text


def read_new(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def with_item_columns(items: DataFrame, text_col: str = "text") -> DataFrame:
    """items, stream or table, with the cleaned text, its tokens and the contacts."""
    t = F.col(text_col)
    return items.withColumns({"cleaned": text.clean_text(t), "tokens": text.tokens(t), **contact.contacts(t)})


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and keys; those later than the watermark are left out."""
    events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))  # a watermark takes no other type
    counted = events.withWatermark(time_col, late).groupBy(F.window(time_col, window), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def process_new(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = with_item_columns) -> StreamingQuery:
    """Appends what has come since the last run to out, then stops; the checkpoint
    remembers the files done, so a broken run goes on where it was."""
    writer = transform(stream).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, keys: list[str], out: str, checkpoint: str, time_col: str | None = None, late: str = "2 hours") -> StreamingQuery:
    """Appends rows to out so that each batch and each key counts once, whatever is run again.

    A batch is written to a folder named by its number, in place of what a broken run left
    there. Rows whose keys came before go: within the watermark of time_col, where given (the
    state stays bounded), else of all time.
    """
    if time_col:
        fresh = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
    else:
        fresh = stream.dropDuplicates(keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """What append_once() has written."""
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
