"""Text forms of query boxes and maps, and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_boxes(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(qid, lo1.., hi1..) from lines of ``2 * dims`` numbers, all lows first."""
    parts = F.split(F.trim("value"), r"\s+")
    names = [f"lo{k}" for k in range(1, dims + 1)] + [f"hi{k}" for k in range(1, dims + 1)]
    lines = spark.read.text(path).where(F.size(parts) == 2 * dims)
    return lines.select(F.monotonically_increasing_id().alias("qid"), *(parts[i].cast("double").alias(n) for i, n in enumerate(names)))


TYPES = {"int": "int", "long": "bigint", "float": "double"}


def read_map(spark: SparkSession, path: str, key: str = "string", value: str = "string", turned: bool = False) -> DataFrame:
    """(key, value) of a tab-separated file, cast to int, long or float if asked for; ``turned``: the columns exchanged."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path)
    pair = raw.select(F.col("_c0").cast(TYPES.get(key, key)).alias("key"), F.col("_c1").cast(TYPES.get(value, value)).alias("value"))
    return pair.select(F.col("value").alias("key"), F.col("key").alias("value")) if turned else pair


def write_map(pairs: DataFrame, path: str) -> None:
    pairs.select(F.col("key").cast("string"), F.col("value").cast("string")).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, name, length) of the files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
