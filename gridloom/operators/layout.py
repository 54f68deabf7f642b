"""Shards and pages: columns cut by predicted position, shards cut by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import GridConfig
from .columns import predict
from .order import running_total


def raw_shard(config: GridConfig) -> Column:
    return F.greatest(F.floor(predict(F.col("key") - F.col("min_key")) / config.page_size).cast("long"), F.lit(0).cast("long"))


def shards(placed: DataFrame, weights: DataFrame, config: GridConfig) -> DataFrame:
    """``placed`` with ``local`` (shard within its column) and ``shards`` (how many the column has).

    A column of a page or less is one shard. If the last shard is short of a page, trailing shards merge backwards until they
    hold more than a page. Counts by shard decide; points only look their shard up.
    """
    raw = placed.join(weights, "col_id").withColumn("raw", raw_shard(config)).drop("alphas", "betas")
    counts = raw.groupBy("col_id", "raw").agg(F.count("*").alias("c"))
    w = Window.partitionBy("col_id").orderBy(F.desc("raw"))  # shards of a column
    back = counts.withColumn("tail", F.sum("c").over(w)).withColumn("nth", F.row_number().over(w))
    last = back.groupBy("col_id").agg(
        F.sum("c").alias("total"),
        F.max("raw").alias("top"),
        F.max(F.when(F.col("nth") == 1, F.col("c"))).alias("c_last"),
        F.max(F.when((F.col("nth") > 1) & (F.col("tail") > config.page_size), F.col("raw"))).alias("merge"),
    )
    p = config.page_size
    zero = F.lit(0).cast("long")
    most = F.when((F.col("total") <= p), zero).when(F.col("c_last") >= p, F.col("top")).otherwise(F.coalesce("merge", zero))
    limits = last.select("col_id", most.alias("limit"))
    return raw.join(F.broadcast(limits), "col_id").withColumn("local", F.least("raw", "limit")).withColumn("shards", F.col("limit") + 1).drop("raw", "limit", "min_key", "n")


def number_shards(local: DataFrame) -> DataFrame:
    """With ``shard_id``: shards numbered through all columns, empty ones too."""
    own = local.groupBy("col_id").agg(F.max("shards").alias("s"))
    first = own.select("col_id", (F.sum("s").over(Window.orderBy("col_id")) - F.col("s")).alias("first"))  # one row for each column
    return local.join(F.broadcast(first), "col_id").withColumn("shard_id", F.col("first") + F.col("local")).drop("first", "shards")


def shard_table(numbered: DataFrame, config: GridConfig) -> DataFrame:
    """(shard_id, col_id, n, start, stop, n_pages, first_page): points [start, stop) in key order."""
    own = numbered.groupBy("shard_id", "col_id").agg(F.count("*").alias("n"), (F.min("rank") - 1).alias("start"), F.max("rank").alias("stop"))
    own = own.withColumn("n_pages", F.ceil(F.col("n") / config.page_size).cast("long"))
    return running_total(own, ["shard_id"], F.col("n_pages"), "first_page").withColumn("first_page", F.col("first_page") - F.col("n_pages"))


def pages(numbered: DataFrame, table: DataFrame, config: GridConfig) -> DataFrame:
    """``numbered`` with ``page_no``: pages of ``page_size`` points in key order within each shard, numbered through."""
    own = numbered.join(table.select("shard_id", "start", "first_page"), "shard_id")
    return own.withColumn("page_no", F.col("first_page") + F.floor((F.col("rank") - 1 - F.col("start")) / config.page_size).cast("long")).drop("start", "first_page")


def split_keys(paged: DataFrame) -> DataFrame:
    """(shard_id, page_no, split_key): the first key of each page but a shard's first."""
    first = paged.groupBy("shard_id", "page_no").agg(F.min("key").alias("split_key"))
    lead = first.groupBy("shard_id").agg(F.min("page_no").alias("p"))
    return first.join(lead, "shard_id").where("page_no > p").drop("p")


def page_bounds(paged: DataFrame) -> DataFrame:
    """(page_no, shard_id, n, low, high): size and key range of each page."""
    return paged.groupBy("page_no", "shard_id").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def lookup(keys: DataFrame, weights: DataFrame, table: DataFrame, starts: list[float], single: bool = False) -> DataFrame:
    """``keys`` (key, ...) with ``shard_id`` as the models predict it; ``single``: weights and keys as 32-bit floats."""
    from .columns import column_of

    config_pages = table.groupBy("col_id").agg(F.min("shard_id").alias("first"), F.max("shard_id").alias("last"))
    own = keys.withColumn("col_id", column_of(F.col("key"), starts)).join(weights, "col_id").join(config_pages, "col_id")
    t = F.col("key") - F.col("min_key")
    if single:
        own = own.withColumn("alphas", F.transform("alphas", lambda a: a.cast("float"))).withColumn("betas", F.transform("betas", lambda b: b.cast("float")))
        terms = F.zip_with("alphas", "betas", lambda a, b: a * F.greatest(t.cast("float") - b, F.lit(0.0).cast("float")))
        position = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    else:
        position = predict(t)
    return own.withColumn("position", position).drop("alphas", "betas", "min_key", "n")


def shard_at(found: DataFrame, config: GridConfig) -> DataFrame:
    """``found`` of :func:`lookup` with ``shard_id``, kept within the shards of the column."""
    local = F.greatest(F.floor(F.col("position") / config.page_size).cast("long"), F.lit(0).cast("long"))
    return found.withColumn("shard_id", F.least(F.col("first") + local, F.col("last"))).drop("first", "last", "position")


def page_of(found: DataFrame, bounds: DataFrame) -> DataFrame:
    """``found`` (key, shard_id) with ``page_no``: the last page of the shard that begins at or below the key, -1 if empty."""
    per = bounds.groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("low", "page_no"))).alias("p"))
    below = F.filter("p", lambda e: e["low"] <= F.col("key"))
    page = F.coalesce(F.get(below, F.size(below) - 1)["page_no"], F.get("p", F.lit(0))["page_no"], F.lit(-1).cast("long"))
    return found.join(per, "shard_id", "left").withColumn("page_no", page).drop("p")


def shards_per_column(table: DataFrame) -> DataFrame:
    """(col_id, n_shards, first_shard) of the shards that hold points."""
    return table.groupBy("col_id").agg(F.count("*").alias("n_shards"), F.min("shard_id").alias("first_shard"))


def rebuilt(paged: DataFrame, key: str = "pid") -> DataFrame:
    """Points in the order of shards, pages and keys: ``place`` from 1, the rank that they were paged by."""
    from .order import ranked

    return ranked(paged, ["shard_id", "page_no", "key", key], name="place")


def save(paged: DataFrame, weights: DataFrame, table: DataFrame, splits: DataFrame, path: str) -> None:
    """The index as Parquet: points by column in key order, and its tables."""
    paged.repartitionByRange("col_id", "key").sortWithinPartitions("col_id", "key").write.mode("overwrite").partitionBy("col_id").parquet(f"{path}/points")
    for name, df in (("weights", weights), ("shards", table), ("splits", splits)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("points", "weights", "shards", "splits")}
