"""Batched inserts and bag deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import GridConfig
from ..plans.staging import stage
from .columns import column_of
from .grid import Grid
from .layout import lookup, shard_at, shard_table
from .order import ranked


def insert(points: DataFrame, batch: DataFrame) -> DataFrame:
    return points.unionByName(batch)


def insert_placed(placed: DataFrame, batch: DataFrame, grid: Grid, starts: list[float]) -> DataFrame:
    """Keyed points in their columns with a batch keyed and placed alike; shards and pages follow from the new ranks."""
    keyed = grid.keyed(batch)
    keyed = keyed.withColumn("col_id", column_of(F.col("key"), starts))
    return placed.drop("rank").unionByName(keyed, allowMissingColumns=True)


def settled(points: DataFrame, targets: DataFrame, dims: list[str], tolerance: float) -> DataFrame:
    """``targets`` moved to the coordinates of their first match, in the order of coordinates: the points within ``tolerance`` in every
    dimension, ends included. A target without one is left out. Both sides meet in cells of twice the tolerance, a target in all
    that its reach overlaps."""
    width = 2 * tolerance
    cell = lambda c: F.floor(c / width).cast("long")
    asked = targets.select(F.struct(*dims).alias("__t")).groupBy("__t").agg(F.count("*").alias("__n"))
    for k, c in enumerate(dims):
        v = F.col("__t")[c]
        asked = asked.withColumn(f"__c{k}", F.explode(F.sequence(cell(v - tolerance), cell(v + tolerance))))
    placed = points.select(*dims, *(cell(F.col(c)).alias(f"__c{k}") for k, c in enumerate(dims))).distinct()
    met = placed.join(asked, [f"__c{k}" for k in range(len(dims))])
    for c in dims:
        met = met.where(F.abs(F.col(c) - F.col("__t")[c]) <= tolerance)
    first = met.groupBy("__t", "__n").agg(F.min(F.struct(*dims)).alias("__p"))
    return first.select(F.explode(F.array_repeat("__p", F.col("__n").cast("int"))).alias("__p")).select("__p.*")


def doomed(points: DataFrame, targets: DataFrame, dims: list[str], key: str = "pid", tolerance: float = 0.0) -> DataFrame:
    """(key) of the points that go: for each target row one point of the same coordinates, lowest ids first.

    With a tolerance, a target stands for the first point within it in every dimension (:func:`settled`).
    """
    targets = settled(points, targets, dims, tolerance) if tolerance else targets
    keys = [f"__k{i}" for i in range(len(dims))]
    wanted = targets.select(*(F.col(c).alias(k) for c, k in zip(dims, keys))).groupBy(*keys).agg(F.count("*").alias("__n"))
    met = points.select(key, *(F.col(c).alias(k) for c, k in zip(dims, keys))).join(wanted, keys)
    w = Window.partitionBy(*keys).orderBy(key)
    return met.withColumn("__i", F.row_number().over(w)).where("__i <= __n").select(key)


def delete(points: DataFrame, targets: DataFrame, dims: list[str], key: str = "pid", tolerance: float = 0.0) -> DataFrame:
    """``points`` less one row for each target row that has a match; a target without one does nothing."""
    return points.join(doomed(points, targets, dims, key, tolerance), key, "left_anti").select(points.columns)


def insert_shards(numbered: DataFrame, keyed: DataFrame, weights: DataFrame, table: DataFrame, starts: list[float], config: GridConfig) -> tuple[DataFrame, DataFrame]:
    """Points with ``shard_id`` after a keyed batch has gone where the models send it, and the shards with their pages.

    Models and column boundaries stay. Shards are (shard_id, col_id, n, start, stop, n_pages, first_page) over all points in the order
    of shard, key and id: pages that overflow are split, pages of shards that shrink are merged, as pages follow from places.
    """
    placed = shard_at(lookup(keyed, weights, table, starts), config)
    both = numbered.select("pid", "key", "col_id", "shard_id", *config.axes).unionByName(placed.select("pid", "key", "col_id", "shard_id", *config.axes))
    ranks = stage(ranked(both, ["shard_id", "key", "pid"]))
    return ranks, stage(shard_table(ranks, config))


def append(batch: DataFrame, path: str, by: str = "col_id") -> None:
    """Add a keyed batch to a stored index: new files in its columns."""
    batch.write.mode("append").partitionBy(by).parquet(path)


def misplaced(inserted: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row: how many inserted keys (key, page_no) lie outside the pages beside their own."""
    near = bounds.select(F.explode(F.array(F.col("page_no") - 1, F.col("page_no"), F.col("page_no") + 1)).alias("page_no"), "low", "high")
    span = near.groupBy("page_no").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return inserted.join(span, "page_no").agg(F.count_if((F.col("key") < F.col("low")) | (F.col("key") > F.col("high"))).alias("n_misplaced"))
