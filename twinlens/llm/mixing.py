"""Mixing sources to target weights by systematic sampling.

A source's documents are expected target / source size times each. The running
sum of these expectations over the source, shifted by one random offset, is cut
at the integers: a document is emitted once for each integer its step crosses.
Documents run in order of size, so the words taken differ from the target by about
one document at most. As that one may be a large part of a small source, documents
above a fiftieth of their source go first, by themselves, and the others are expected
as often as brings the words taken by both to the target.

The running sum is a prefix sum in two levels, over bins (size class and hash) and over
the rows of a bin, so no source has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import free_name, quoted, stored, word_count

#: Rows that a bin of one size class of one source is to hold, about.
BIN_ROWS = 200_000
#: Documents above this share of their source are large; a source has so many at most.
LARGE = 50


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank from 0 in code-point order, null last, stored: a sort by
    ranges, whose places in a range are numbered after those of the ranges before."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = stored(s.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("place", 33)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = s.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return s.withColumn("part", part).join(before, "part").select("source", "source_size", rank.alias("rank"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources in code-point order (null last) weigh `weights` in turn and share
    `share` times all sizes; no target exceeds `cap` times its source's size and
    the excess is shared again by weight. That is one water level: sources whose
    cap per weight lies below it are full, the others get level times weight. It rises
    with each round until no more are full; a round is one sum over the sources, of
    which two numbers come to the driver. No rows give no targets.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = _ranked_sources(sizes).withColumn("w", weight).withColumn("full", F.col("source_size") * F.lit(cap))
    level, n_full = 0.0, None
    first = s.agg(F.sum("source_size").alias("all"), F.sum("w").alias("w")).first()
    if first["w"]:
        total = share * first["all"]
        level = total / first["w"]
        while True:
            is_full = F.col("w") * F.lit(level) > F.col("full")
            r = s.agg(F.count(F.when(is_full, 1)).alias("n"), F.sum(F.when(is_full, F.col("full"))).alias("full"), F.sum(F.when(~is_full, F.col("w"))).alias("w")).first()
            if r["n"] == n_full or r["w"] is None:
                break
            n_full, level = r["n"], (total - (r["full"] or 0.0)) / r["w"]
    return s.select("source", "source_size", F.least(F.col("full"), F.col("w") * F.lit(level)).alias("target"))


def _class(size: Column, source_size: Column) -> Column:
    """-1 for the large documents of a source, else classes that grow by a twentieth."""
    return F.when(size * LARGE > source_size, F.lit(-1)).otherwise(F.floor(F.log(size + F.lit(1.0)) * 20)).cast("int")


def _crossed(upto: Column, rate: Column, source: Column, seed: int) -> Column:
    """Integers that the upto-th step of `rate` crosses, from the source's offset on."""
    start = F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return F.floor(start + upto * rate) - F.floor(start + (upto - 1) * rate)


def mix_sources(df: DataFrame, id_col: str = "doc_id", size: Column | None = None, seed: int = 0, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """df with _size, _source_size, _target and _copies.

    _size is `size` (default: words of `text`; null text: 0). _copies is how often
    the mix takes the row, cap at most. The same rows give the same mix on every
    run. Null sources are a source of their own; ties and repeated rows are
    taken independently; rows of size 0 have copies too, which take no words. An empty
    table gives an empty one; other columns pass through, whatever their names, but for
    own columns named as the four, which are replaced.
    """
    own = [c for c in df.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    size = (word_count(F.col("text")) if size is None else size).cast("long")
    key = F.col(quoted(id_col))
    h = F.xxhash64(key, F.lit(seed))
    order = ["size", "h", "id"]
    narrow = stored(df.select(F.col("source").alias("source"), key.alias("id"), size.alias("size"), h.alias("h")), "mix-sizes")
    t = source_targets(narrow.select("source", "size"), share, cap, weights).withColumnRenamed("source", "s")
    t = stored(t.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))), "mix-targets")
    classed = narrow.join(t, narrow["source"].eqNullSafe(t["s"])).withColumn("class", _class(F.col("size"), F.col("source_size")))
    # the large ones of a source: LARGE rows at most
    place = F.row_number().over(Window.partitionBy("s").orderBy(*order))
    large = classed.where("class = -1").withColumn("copies", F.least(_crossed(place, F.col("rate"), F.col("s"), seed), F.floor(F.lit(cap))))
    large = large.groupBy("s").agg(F.sum("size").alias("large"), F.sum(F.col("size") * F.col("copies")).alias("large_taken"))
    counts = classed.groupBy("s", "class").agg(F.ceil(F.count("*") / BIN_ROWS).alias("parts"))
    counts = counts.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("parts"))  # an entry a class
    rest = F.try_divide(F.col("target") - F.col("large_taken"), F.col("source_size") - F.col("large"))
    rest = F.when(F.col("large").isNull(), F.col("rate")).otherwise(F.least(F.greatest(F.coalesce(rest, F.lit(0.0)), F.lit(0.0)), F.lit(cap)))
    for other in (large, counts):
        other = other.withColumnRenamed("s", "s2")
        t = t.join(other, t["s"].eqNullSafe(other["s2"]), "left").drop("s2")
    t = stored(t.withColumn("rest", rest), "mix-rates")
    part = F.pmod(F.col("h"), F.element_at("parts", F.col("class"))).alias("part")
    dealt = classed.select("source", "h", "class").join(t.select("s", "parts"), F.col("source").eqNullSafe(F.col("s"))).select("s", "class", part)
    before = Window.partitionBy("s", F.col("class") == -1).orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    bins = dealt.groupBy("s", "class", "part").agg(F.count("*").alias("n")).select("s", "class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bins = stored(bins, "mix-bins")

    # the rows themselves: one shuffle, to the bins
    row, at = free_name(df, "_row"), free_name(df, "_at")
    rows = df.select(F.struct(*map(quoted, own)).alias(row), F.struct(F.col("source").alias("source"), size.alias("size"), h.alias("h"), key.alias("id")).alias(at)).select(row, f"{at}.*")
    rows = rows.join(t, rows["source"].eqNullSafe(t["s"])).withColumn("class", _class(F.col("size"), F.col("source_size")))
    rows = rows.withColumn("part", part).drop("s", "parts")
    rows = rows.join(bins, rows["source"].eqNullSafe(bins["s"]) & (rows["class"] == bins["class"]) & (rows["part"] == bins["part"])).drop(bins["s"], bins["class"], bins["part"])
    rank = F.row_number().over(Window.partitionBy("source", "class", "part").orderBy(*order))
    rate = F.when(F.col("class") == -1, F.col("rate")).otherwise(F.col("rest"))
    copies = F.least(_crossed(F.col("before") + rank, rate, F.col("source"), seed), F.floor(F.lit(cap))).cast("int")
    out = rows.withColumn("copies", copies)
    return out.select(f"{row}.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies").alias("_copies"))


def emit_copies(mixed: DataFrame, untaken: bool = False) -> DataFrame:
    """The mix: a row of mix_sources() for each integer crossed, numbered from 1 by
    _copy; with untaken, also one with _copy null for each row that is not taken."""
    numbers = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies")))
    return mixed.select("*", (F.explode_outer if untaken else F.explode)(numbers).alias("_copy"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, summed over its emitted rows,
    whole texts. Nulls, ties, repeated rows and empty tables as in mix_sources() (rows of
    one doc_id are summed up); other columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    emitted = emit_copies(mix_sources(docs, seed=8), untaken=True)
    taken = F.sum(F.when(F.col("_copy").isNotNull(), word_count(F.col("text"))).otherwise(F.lit(0)))
    out = emitted.groupBy("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"))
    return out.agg(taken.cast("long").alias("taken"))
