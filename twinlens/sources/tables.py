"""Reading tables, lists of JSON items and resuming work that is partly done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table with a header and quoted fields that may hold line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType, rejected: str = "_rejected") -> DataFrame:
    """One object a line; a broken line is kept in the column `rejected`."""
    return spark.read.schema(schema.add(rejected, "string")).option("columnNameOfCorruptRecord", rejected).json(path)


def with_properties(df: DataFrame, json_col: str, to: str = "properties") -> DataFrame:
    """df with a map of strings parsed from a JSON column; broken JSON is null."""
    return df.withColumn(to, F.from_json(json_col, "map<string,string>"))


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, missing: str = "None") -> DataFrame:
    """df left-joined to a dimension; text columns without a match get `missing`. The
    join is broadcast when Spark finds the dimension small enough, else shuffled."""
    text = [f.name for f in dimension.schema if f.name != key and f.dataType.simpleString() == "string"]
    return df.join(dimension, key, "left").fillna(missing, text)


def not_yet_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key has no result yet; rows with a null key are not done."""
    return df.join(done.select(key), key, "left_anti")


def write_parts(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends df as Parquet, in folders by columns if any are given."""
    (df.write.mode("append").partitionBy(*by) if by else df.write.mode("append")).parquet(path)


def read_keyed_json(spark: SparkSession, path: str, schema: StructType, key: str = "id", rejected: str = "_rejected") -> DataFrame:
    """Lines 'key <tab> object' of all files under path; a line whose object cannot be read
    keeps it in the column `rejected`."""
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).alias(key), F.expr("substring(value, instr(value, '\t') + 1)").alias("_json"))
    parsed = F.from_json("_json", schema.add(rejected, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": rejected})
    return lines.select(key, parsed.alias("_p")).select(key, "_p.*")


def write_keyed_json(df: DataFrame, path: str, key: str) -> None:
    """The same format: key, tab, the other columns as one object a line."""
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.to_json(F.struct(*[c for c in df.columns if c != key]))).alias("value")).write.mode("overwrite").text(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, correct) from lines 'correct=wrong,wrong'; empty parts are left out."""
    line = spark.read.text(path).where(F.col("value").contains("="))
    parts = F.filter(F.transform(F.split(F.substring_index("value", "=", -1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return line.select(F.explode(parts).alias("wrong"), F.trim(F.substring_index("value", "=", 1)).alias("correct"))


def corrected_words(words: DataFrame, corrections: DataFrame, word: str = "term") -> DataFrame:
    """words with each in its corrected form, by a join."""
    fixed = corrections.select(F.col("wrong").alias("_wrong"), F.col("correct").alias("_correct"))
    out = words.join(fixed, words[word] == fixed["_wrong"], "left")
    return out.withColumn(word, F.coalesce("_correct", word)).drop("_wrong", "_correct")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a short resource, such as the endings that hosts may have."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).where("trim(value) <> ''").distinct().orderBy(F.lit(1)).collect()]


def read_named_parts(spark: SparkSession, pattern: str, name: str = "file") -> DataFrame:
    """All CSV files of a pattern with the name of the file that a row is from."""
    return spark.read.option("header", True).option("inferSchema", True).csv(pattern).withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """df as CSV with a header instead of what is there; compressed: gzip."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def split_rejected(df: DataFrame, rejected: str = "_rejected") -> tuple[DataFrame, DataFrame]:
    """(good rows without the column, broken ones as an error table)."""
    return df.where(F.col(rejected).isNull()).drop(rejected), df.where(F.col(rejected).isNotNull()).select(F.col(rejected).alias("line"))


def columns_with(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text in c]
