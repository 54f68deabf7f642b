"""The index as one object: built once, saved, loaded, and asked without building it again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import GridConfig
from ..plans.staging import stage
from . import columns, dml, grid, layout, ranges

TABLES = ("points", "splits", "weights", "shards", "bounds")


@dataclass(frozen=True)
class Index:
    """Points (pid, x1.., key, col_id, shard_id, page_no), cuts of the grid, models, shards, and key ranges of pages.

    ``starts`` are the keys where columns 1, 2, ... begin: at most as many numbers as models. Nothing is changed in place: inserts
    and deletes give another index over the same cuts and models.
    """

    config: GridConfig
    starts: list[float]
    points: DataFrame
    splits: DataFrame
    weights: DataFrame
    shards: DataFrame
    bounds: DataFrame

    @staticmethod
    def build(points: DataFrame, config: GridConfig, fitted: bool = False) -> Index:
        """An index of ``points`` (pid, x1..); ``fitted``: models by least squares, else polylines through the knots."""
        cuts = grid.build_grid(points, config)
        ranks = stage(grid.ordered(cuts.keyed(points)))
        starts = columns.boundaries(ranks, config)
        placed = columns.with_columns_of(ranks, starts)
        stats = stage(columns.column_stats(placed, config))
        pairs = columns.training_pairs(placed, stats)
        weights = stage(columns.train(pairs, stats, config) if fitted else columns.interpolate(columns.knots(pairs, config), stats))
        numbered = stage(layout.number_shards(layout.shards(placed, weights, config)))
        return Index._of(config, starts, cuts.splits, weights, numbered, stage(layout.shard_table(numbered, config)))

    @staticmethod
    def _of(config: GridConfig, starts: list[float], splits: DataFrame, weights: DataFrame, numbered: DataFrame, table: DataFrame) -> Index:
        own = layout.pages(numbered, table, config).select("pid", *config.axes, "key", "col_id", "shard_id", "rank", "page_no")
        own = stage(own)
        return Index(config, starts, own, splits, weights, table, stage(layout.page_bounds(own)))

    @property
    def grid(self) -> grid.Grid:
        levels = [grid.level_of(self.splits.where(F.col("level") == k)) for k in range(self.config.dims - 1)]
        return grid.Grid(self.config, self.splits, levels)

    def save(self, path: str) -> None:
        """Parquet tables, points by column in key order, and one row with the rest."""
        self.points.repartitionByRange("col_id", "key").sortWithinPartitions("col_id", "key").write.mode("overwrite").partitionBy("col_id").parquet(f"{path}/points")
        for name in TABLES[1:]:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.points.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.config)), [float(s) for s in self.starts])], "config string, starts array<double>").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        about = spark.read.parquet(f"{path}/about").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        tables["points"] = tables["points"].withColumn("col_id", F.col("col_id").cast("long"))
        return Index(GridConfig(**json.loads(about["config"])), list(about["starts"]), **tables)

    def box(self, boxes: DataFrame) -> DataFrame:
        """(qid, n, n_pages) of each box: points, and pages visited."""
        return ranges.range_by_index(self.points, self.bounds, boxes, self.grid)

    def find(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, ...) with the shard that the models send them to and the page within it."""
        found = layout.shard_at(layout.lookup(keys, self.weights, self.shards, self.starts), self.config)
        return layout.page_of(found, self.bounds)

    def insert(self, batch: DataFrame) -> Index:
        """With a batch (pid, x1..) in the shards where the models send it; pages that overflow are split."""
        ranks, table = dml.insert_shards(self.points, self.grid.keyed(batch), self.weights, self.shards, self.starts, self.config)
        return Index._of(self.config, self.starts, self.splits, self.weights, ranks, table)

    def delete(self, targets: DataFrame, tolerance: float = 0.0) -> Index:
        """Without one point for each target row (x1..) that has a match; pages that shrink are merged."""
        left = dml.delete(self.points, targets, self.config.axes, tolerance=tolerance)
        ranks = stage(dml.ranked(left.drop("rank", "page_no"), ["shard_id", "key", "pid"]))
        return Index._of(self.config, self.starts, self.splits, self.weights, ranks, stage(layout.shard_table(ranks, self.config)))

    def with_models(self, weights: DataFrame) -> Index:
        """The same index with other models; where points lie does not change."""
        return replace(self, weights=weights)
