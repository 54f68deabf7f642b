"""Equi-depth grid and monotone one-dimensional key.

Dimension by dimension, each strip is cut at the last value of each of ``parts`` equally long runs of its sorted points. Cells
are closed on the left and open on the right, the last one closed on both sides, so a tie goes right. The key of a point is

    eta * prod_k((x_k - front_k) / length_k) + x_d / hi * (parts - 1) + parts * cell

over all dimensions k but the last, and grows with every coordinate; a strip of no length contributes 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import GridConfig
from ..plans.staging import stage
from .order import ranked


def _tile(rank: Column, n: Column, parts: int) -> Column:
    """The run, from 0, of a rank, from 1: the first ``n mod parts`` runs have one row more than the others."""
    short, more = F.floor(n / parts).cast("long"), (n % parts).cast("long")
    long_rows = more * (short + 1)
    late = more + F.floor((rank - long_rows - 1) / F.greatest(short, F.lit(1))).cast("long")
    return F.when(rank <= long_rows, F.floor((rank - 1) / (short + 1)).cast("long")).otherwise(late)


def equi_depth(points: DataFrame, column: str, parts: int, hi: float, within: str | None = None, key: str = "pid") -> DataFrame:
    """(parent, part, lb, ub): the cuts of ``column``, in each group of ``within`` if given."""
    parent = F.col(within) if within else F.lit(0).cast("long")
    own = points.select(parent.alias("parent"), F.col(column).alias("v"), F.col(key).alias("k"))
    sizes = own.groupBy("parent").agg(F.count("*").alias("n"))
    tiles = ranked(own, ["v", "k"], ["parent"]).join(sizes, "parent").select("parent", "v", _tile(F.col("rank"), F.col("n"), parts).alias("part"))
    ends = tiles.groupBy("parent", "part").agg(F.max("v").alias("ub"))
    w = Window.partitionBy("parent").orderBy("part")  # as many rows as parts
    last = F.lead("ub").over(w).isNull()
    return ends.select("parent", "part", F.lag("ub", 1, 0.0).over(w).alias("lb"), F.when(last, F.lit(hi)).otherwise(F.col("ub")).alias("ub"))


def cell_in(value: Column, inner: Column) -> Column:
    """Number of inner cuts at or below ``value``."""
    return F.size(F.filter(inner, lambda s: s <= value)).cast("long")


@dataclass
class Grid:
    """Cuts by level: (parent, inner array of cuts between parts, lbs, ubs)."""

    config: GridConfig
    splits: DataFrame
    levels: list[DataFrame]

    def assign(self, points: DataFrame, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
        """``points`` with ``cell`` and, for each cut dimension k, ``front_k`` and ``back_k``."""
        columns = columns or self.config.axes
        out = points.withColumn(f"{prefix}cell", F.lit(0).cast("long"))
        for k, level in enumerate(self.levels):
            out = _step(out, level, F.col(columns[k]), k, self.config, prefix)
        return out

    def keyed(self, points: DataFrame, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
        """:meth:`assign` and the monotone key, ``key``."""
        columns = columns or self.config.axes
        return self.assign(points, columns, prefix).withColumn(f"{prefix}key", key_of(self.config, columns, prefix))


def key_of(config: GridConfig, columns: list[str], prefix: str = "") -> Column:
    share = F.lit(1.0)
    for k in range(config.dims - 1):
        length = F.col(f"{prefix}back_{k}") - F.col(f"{prefix}front_{k}")
        share = share * F.when(length > 0, (F.col(columns[k]) - F.col(f"{prefix}front_{k}")) / length).otherwise(F.lit(0.0))
    t = config.parts
    return F.lit(config.eta) * share + F.col(columns[-1]) / F.lit(config.hi) * F.lit(float(t - 1)) + F.lit(float(t)) * F.col(f"{prefix}cell")


def _step(out: DataFrame, level: DataFrame, value: Column, k: int, config: GridConfig, prefix: str) -> DataFrame:
    """One level down: a strip that holds no point is one part."""
    cell = f"{prefix}cell"
    joined = out.join(level.withColumnRenamed("parent", "__parent"), F.col(cell) == F.col("__parent"), "left")
    part = F.when(F.col("inner").isNull(), F.lit(0).cast("long")).otherwise(cell_in(value, F.col("inner")))
    return (
        joined.withColumn("__part", part)
        .withColumn(f"{prefix}front_{k}", F.coalesce(F.get("lbs", F.col("__part").cast("int")), F.lit(0.0)))
        .withColumn(f"{prefix}back_{k}", F.coalesce(F.get("ubs", F.col("__part").cast("int")), F.lit(config.hi)))
        .withColumn(cell, F.col(cell) * config.parts + F.col("__part"))
        .drop("__parent", "inner", "lbs", "ubs", "__part")
    )


def level_of(splits: DataFrame) -> DataFrame:
    """Cuts as arrays by parent: as many entries as parts."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "lb", "ub")))
    arrays = splits.groupBy("parent").agg(ordered.alias("s"))
    return arrays.select("parent", F.transform(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), lambda e: e["ub"]).alias("inner"), F.transform("s", lambda e: e["lb"]).alias("lbs"), F.transform("s", lambda e: e["ub"]).alias("ubs"))


def build_grid(points: DataFrame, config: GridConfig, key: str = "pid") -> Grid:
    """Cut dimensions 1 to d - 1, each within the strips of the ones before. ``splits``: (level, parent, part, lb, ub)."""
    at = points.withColumn("cell", F.lit(0).cast("long"))
    levels, all_splits = [], None
    for k, column in enumerate(config.axes[:-1]):
        splits = stage(equi_depth(at, column, config.parts, config.hi, "cell", key))
        level = stage(level_of(splits))
        levels.append(level)
        named = splits.withColumn("level", F.lit(k))
        all_splits = named if all_splits is None else all_splits.unionByName(named)
        at = _step(at, level, F.col(column), k, config, "").drop(f"front_{k}", f"back_{k}")
    return Grid(config, all_splits, levels)


def borders(grid: Grid) -> DataFrame:
    """(cell, front_k, back_k, measure) of every cell: the product of the lengths of its strips."""
    out = None
    for k in range(grid.config.dims - 1):
        own = grid.splits.where(F.col("level") == k).select("parent", (F.col("parent") * grid.config.parts + F.col("part")).alias("child"), F.col("lb").alias(f"front_{k}"), F.col("ub").alias(f"back_{k}"))
        out = own.drop("parent").withColumnRenamed("child", "cell") if out is None else out.join(own, F.col("cell") == F.col("parent")).drop("cell", "parent").withColumnRenamed("child", "cell")
    measure = F.lit(1.0)
    for k in range(grid.config.dims - 1):
        measure = measure * (F.col(f"back_{k}") - F.col(f"front_{k}"))
    return out.withColumn("measure", measure)


def ordered(keyed: DataFrame, key: str = "pid") -> DataFrame:
    """Keyed points in their global order: ``rank`` from 1, ties by id. Physically: range partitions, sorted."""
    return ranked(keyed, ["key", key])


def last_splits(points: DataFrame, config: GridConfig, key: str = "pid") -> DataFrame:
    """(parent, part, lb, ub) of the last dimension over all points; the key does not use them."""
    return equi_depth(points, config.axes[-1], config.parts, config.hi, key=key)
