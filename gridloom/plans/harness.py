"""Timed runs of the engine's operators over a point set, and their report.

Each part gives rows (size, part, metric, value); a part that fails at a size gives one row with metric ``failed`` and does not
stop the others. Times are of whole actions, in seconds.
"""

from __future__ import annotations

import platform
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, dml, knn, metrics, ranges
from ..operators.index import Index
from ..operators.prep import subsample
from .config import GridConfig, axes
from .staging import stage

SCHEMA = "size long, part string, metric string, value double"


def _timed(action: Callable[[], object]) -> tuple[float, object]:
    began = time.perf_counter()
    out = action()
    return time.perf_counter() - began, out


def build(points: DataFrame, config: GridConfig) -> dict[str, float]:
    """Build with polylines and with fitted models; the ratio of their losses; keys that are out of order."""
    plain, index = _timed(lambda: Index.build(points, config))
    fitted, other = _timed(lambda: Index.build(points, config, fitted=True))
    stats = columns.column_stats(index.points, config)
    pairs = stage(columns.training_pairs(index.points, stats))
    loss = [columns.losses(pairs, i.weights).agg(F.sum("loss")).first()[0] for i in (index, other)]
    return {"seconds": plain, "seconds_fitted": fitted, "loss": loss[0], "loss_ratio": loss[1] / loss[0] if loss[0] else 1.0}


def lookup(points: DataFrame, config: GridConfig, n: int = 10_000) -> dict[str, float]:
    """Learned lookups of sampled keys: the share that finds the key's own page, and with 32-bit models its own shard."""
    from ..operators import layout

    index = Index.build(points, config)
    keys = stage(subsample(index.points, n).select("pid", "key", F.col("page_no").alias("own"), F.col("shard_id").alias("home")))
    seconds, found = _timed(lambda: stage(index.find(keys.select("pid", "key"))))
    right = found.join(keys.select("pid", "own"), "pid").agg(F.avg((F.col("page_no") == F.col("own")).cast("double"))).first()[0]
    single = layout.shard_at(layout.lookup(keys, index.weights, index.shards, index.starts, True), config)
    return {"seconds": seconds, "exact": right or 0.0, "exact_32_bit": single.agg(F.avg((F.col("shard_id") == F.col("home")).cast("double"))).first()[0] or 0.0}


def boxes(points: DataFrame, config: GridConfig, asked: DataFrame) -> dict[str, float]:
    """The same boxes through the index, by tiles and by brute force: seconds, points a box, and whether all agree."""
    index = Index.build(points, config)
    by_index, a = _timed(lambda: stage(index.box(asked)))
    by_tiles, b = _timed(lambda: stage(ranges.range_counts(points, asked, config.axes)))
    brute, c = _timed(lambda: stage(ranges.brute_counts(points, asked, config.axes)))
    differ = a.select("qid", "n").exceptAll(b).count() + b.exceptAll(c).count()
    return {"seconds_index": by_index, "seconds_tiles": by_tiles, "seconds_brute": brute, "differ": float(differ), "mean_points": a.agg(F.avg("n")).first()[0] or 0.0, "mean_pages": a.agg(F.avg("n_pages")).first()[0] or 0.0}


def neighbours(points: DataFrame, config: GridConfig, asked: DataFrame, k: int = 10) -> dict[str, float]:
    """Exact nearest neighbours, the box-accepting variant and brute force: seconds, and recall of the first two."""
    exact, a = _timed(lambda: stage(knn.knn(points, asked, k, config.axes)))
    box, b = _timed(lambda: stage(knn.knn_box(points, asked, k, config.axes, config.hi / 100)))
    brute, c = _timed(lambda: stage(knn.brute(points, asked, k, config.axes)))
    return {"seconds": exact, "seconds_box": box, "seconds_brute": brute} | {f"recall{n}": metrics.recall(f, c, ["qid", "rank"]).first()[0] or 0.0 for n, f in (("", a), ("_box", b))}


def batches(points: DataFrame, config: GridConfig, sizes: tuple[int, ...] = (1000, 10_000, 100_000)) -> dict[str, float]:
    """Inserts and deletes of batches: seconds each, and whether deleting what was inserted leaves as many points."""
    index = Index.build(points, config)
    total, out = points.count(), {}
    for n in sizes:
        batch = stage(subsample(points, n).withColumn("pid", -F.col("pid") - 1))
        out[f"insert_{n}"], grown = _timed(lambda: index.insert(batch))
        out[f"delete_{n}"], left = _timed(lambda: grown.delete(batch))
        out[f"differ_{n}"] = float(abs(left.points.count() - total))
    return out


def networks(points: DataFrame, config: GridConfig) -> dict[str, float]:
    """Monotone networks against piecewise models: seconds and losses."""
    index = Index.build(points, config)
    stats = columns.column_stats(index.points, config)
    pairs = stage(columns.training_pairs(index.points, stats))
    piecewise, a = _timed(lambda: stage(columns.train(pairs, stats, config)))
    network, b = _timed(lambda: stage(columns.train_mlp(pairs)))
    return {"seconds": piecewise, "seconds_network": network, "loss": columns.losses(pairs, a).agg(F.sum("loss")).first()[0], "loss_network": b.agg(F.sum("loss")).first()[0]}


def run(spark: SparkSession, sources: dict[int, DataFrame], config: GridConfig, parts: dict[str, Callable[[DataFrame, GridConfig], dict[str, float]]]) -> DataFrame:
    """(size, part, metric, value) of every part at every size; what fails is one row and stops nothing."""
    rows = []
    for size, points in sources.items():
        for name, part in parts.items():
            try:
                rows += [(size, name, metric, float(value)) for metric, value in part(points, config).items()]
            except Exception as e:  # noqa: BLE001 - a failing size is a result of the run
                rows.append((size, name, f"failed: {type(e).__name__}", -1.0))
    return spark.createDataFrame(rows, SCHEMA)


def standard(spark: SparkSession, queries: int = 1000, k: int = 10) -> dict[str, Callable[[DataFrame, GridConfig], dict[str, float]]]:
    """All parts with random boxes and centres of the domain."""
    from ..sources.points import random_boxes

    def box(points: DataFrame, config: GridConfig) -> dict[str, float]:
        return boxes(points, config, stage(random_boxes(spark, queries, config.dims, 0.0, config.hi)))

    def near(points: DataFrame, config: GridConfig) -> dict[str, float]:
        own = [(F.rand(7 + i) * config.hi).alias(f"c{i + 1}") for i in range(config.dims)]
        return neighbours(points, config, stage(spark.range(queries // 2 or 1).select(F.col("id").alias("qid"), *own)), k)

    return {"build": build, "lookup": lookup, "boxes": box, "neighbours": near, "batches": batches, "networks": networks}


def about(spark: SparkSession, config: GridConfig) -> list[str]:
    """Lines on the system and the configuration, for the head of a report."""
    return [f"# spark {spark.version}, python {platform.python_version()}, {platform.system()} {platform.machine()}", f"# master {spark.sparkContext.master}, {spark.sparkContext.defaultParallelism} cores", f"# {config}"]


def write_long(runs: DataFrame, config: GridConfig, path: str) -> None:
    """The rows as text: head lines with ``#``, then size,part,metric,value; figures not measured are empty."""
    spark = runs.sparkSession
    lines = [*about(spark, config), "size,part,metric,value"]
    # a few rows for each size
    figures = runs.orderBy("size", "part", "metric").select(F.concat_ws(",", F.col("size").cast("string"), "part", "metric", F.coalesce(metrics.unmeasured(F.col("value")).cast("string"), F.lit("")))).collect()
    spark.createDataFrame([(x,) for x in [*lines, *(r[0] for r in figures)]], "value string").coalesce(1).write.mode("overwrite").text(path)


def speedups(runs: DataFrame, base: str, other: str) -> DataFrame:
    """(size, part, ratio) of two metrics; null unless both are positive."""
    wide = runs.where(F.col("metric").isin(base, other)).groupBy("size", "part").pivot("metric", [base, other]).agg(F.first("value"))
    return wide.select("size", "part", metrics.speedup(F.col(base), F.col(other)).alias("ratio"))
