"""Exact global order without a global window: range partitions, then offsets of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

_IN_PARTITION = (1 << 33) - 1


def sorted_parts(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` in range partitions, written, with ``__part`` and ``__at``, the place of each row in its partition from 0."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    return stage(ordered).select("*", F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND(_IN_PARTITION).alias("__at")).drop("__id")


def ranked(df: DataFrame, by: list[str], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the rank (from 1) of each row in the order ``by``, within groups if asked for.

    Make ``by`` unique (end with an id) for a rank that does not depend on the run. Only one count for each partition is
    gathered; a group may be of any size.
    """
    within = within or []
    parts = sorted_parts(df, [*within, *by])
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row for each partition
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
    if within:
        first = out.groupBy(*within).agg(F.min(name).alias("__first"))
        keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within]
        first = first.select(*(F.col(c).alias(f"__{c}") for c in within), "__first")
        out = out.join(first, keys).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first", *(f"__{c}" for c in within))
    return out


def running_total(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row in the order ``by``: windows over range partitions."""
    parts = sorted_parts(df.withColumn("__v", value), by)
    sums = parts.groupBy("__part").agg(F.sum("__v").alias("__s"))
    offsets = sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + own).drop("__part", "__at", "__v", "__before")


def count_inversions(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """One row: neighbours in the order ``by`` whose ``key`` falls. Neighbours meet across partitions by rank."""
    r = ranked(df.select(*dict.fromkeys([*by, key])), by)
    after = r.select((F.col("rank") - 1).alias("rank"), F.col(key).alias("__next"))
    return r.join(after, "rank").agg(F.count_if(F.col("__next") < F.col(key)).alias("n_inversions"))


def count_dominated(df: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """One row: neighbours in the order ``by`` of which the later one is at or below the earlier in every dimension and below it in
    one. A monotone key leaves none."""
    r = ranked(df.select(*dict.fromkeys([*by, *dims])), by)
    after = r.select((F.col("rank") - 1).alias("rank"), *(F.col(c).alias(f"__{c}") for c in dims))
    under, below = F.lit(True), F.lit(False)
    for c in dims:
        under, below = under & (F.col(f"__{c}") <= F.col(c)), below | (F.col(f"__{c}") < F.col(c))
    return r.join(after, "rank").agg(F.count_if(under & below).alias("n_dominated"))


def count_flat_splits(splits: DataFrame) -> DataFrame:
    """One row: cuts (level, parent, part, ub) that do not lie above the one before."""
    w = Window.partitionBy("level", "parent").orderBy("part")  # as many rows as parts
    return splits.withColumn("__before", F.lag("ub").over(w)).agg(F.count_if(F.col("ub") <= F.col("__before")).alias("n_flat"))
