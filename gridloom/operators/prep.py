"""Cleaning, scaling and sampling of point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ranked


def rescale(points: DataFrame, dims: list[str], lo: float = 0.0, hi: float = 10000.0) -> DataFrame:
    """Each of ``dims`` mapped from its own range to [lo, hi]; a range under 1e-12 counts as that."""
    ends = points.agg(*(f(c).cast("double").alias(f"__{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))))
    scaled = points.crossJoin(F.broadcast(ends))  # one row
    for c in dims:
        span = F.greatest(F.col(f"__max_{c}") - F.col(f"__min_{c}"), F.lit(1e-12))
        scaled = scaled.withColumn(c, (F.col(c) - F.col(f"__min_{c}")) / span * F.lit(hi - lo) + F.lit(lo))
    return scaled.select(*points.columns)


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(value, F.lit(hi)), F.lit(lo))


def clip_points(points: DataFrame, dims: list[str], lo: float, hi: float) -> DataFrame:
    return points.withColumns({c: clip(F.col(c), lo, hi) for c in dims})


def drop_missing(points: DataFrame, dims: list[str]) -> DataFrame:
    """Without rows in which a coordinate is null or NaN."""
    return points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in dims))


def dedupe(points: DataFrame, dims: list[str], digits: int = 5) -> DataFrame:
    """Distinct coordinates after rounding."""
    return points.select(*(F.round(c, digits).alias(c) for c in dims)).distinct()


def subsample(points: DataFrame, n: int, key: str = "pid", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are fewer), by hashed key."""
    return points.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def bootstrap(points: DataFrame, n: int, dims: list[str], key: str = "pid", seed: int = 42, jitter: float = 1e-5) -> DataFrame:
    """``n`` rows drawn with replacement, each coordinate moved by a normal variate of ``jitter`` times its extent."""
    total = points.count()
    ends = points.agg(*((F.max(c) - F.min(c)).alias(f"__w_{c}") for c in dims))
    drawn = points.sparkSession.range(n).select(F.col("id").alias("draw"), (F.floor(F.rand(seed) * total) + 1).alias("rank"))
    moved = drawn.join(ranked(points, [key]), "rank").crossJoin(F.broadcast(ends))  # one row
    return moved.select(F.col("draw").alias("pid"), *((F.col(c) + F.randn(seed + k + 1) * jitter * F.col(f"__w_{c}")).alias(c) for k, c in enumerate(dims)))


def split_sets(points: DataFrame, key: str = "pid") -> DataFrame:
    """With flags: ``is_static`` for the first half in key order, ``is_insert`` for the rest, ``is_delete`` for the second
    half in the order of the key's last six digits read backwards, a second order that overlaps both."""
    n = points.count()
    first = ranked(points, [key], name="__r")
    second = ranked(first.withColumn("__turned", F.reverse(F.lpad((F.col(key) % 1000000).cast("string"), 6, "0"))), ["__turned", key], name="__s")
    half = n // 2
    flags = {"is_static": F.col("__r") <= half, "is_insert": F.col("__r") > half, "is_delete": F.col("__s") > half}
    return second.withColumns(flags).drop("__r", "__s", "__turned")


def product(frames: list[DataFrame]) -> DataFrame:
    """All combinations of the rows of small frames (values of an axis), first frame slowest."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out
