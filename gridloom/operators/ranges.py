"""Box and sphere queries as one equi-join on tiles, and through the index: key intervals, pages, residual test.

Tiles are cut at quantiles of the boxes' own corners, in all dimensions: any cuts give the same answers, as every join ends in
the exact test, and these deal the boxes evenly over the tiles without a pass over the points. A box lists the tiles that it
overlaps, ``TILES`` at most: a box that lists many also holds about as large a share of the points, so listing is never what costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .grid import Grid, key_of
from .places import BLOCK, Strips, along, counted, gathered, known

#: Tiles in all dimensions together, and cuts of one dimension, at most.
TILES, CUTS = 4096, 64


def _cuts(rows: DataFrame, values: list[list[str]], cuts: int) -> list[list[float]]:
    """For each list of columns, inner cuts at quantiles of all their values: at most ``cuts`` numbers each, by one pass."""
    probs = [k / cuts for k in range(1, cuts)]
    own = rows.select(*(F.explode(F.array(*(F.struct(*(F.col(v[k]).alias(f"v{i}") for i, v in enumerate(values))) for k in range(len(values[0]))))).alias("v"),)).select("v.*")
    row = own.agg(*(F.percentile_approx(f"v{i}", probs, 1000).alias(f"v{i}") for i in range(len(values)))).first()
    return [sorted(set(v or [])) for v in row]


def box_cuts(boxes: DataFrame, dims: int) -> list[list[float]]:
    """Inner cuts of every dimension at quantiles of the boxes' corners, ``TILES`` tiles in all at most."""
    each = max(2, min(CUTS, int(TILES ** (1 / dims) + 1e-9)))
    return _cuts(boxes, [[f"lo{k}", f"hi{k}"] for k in range(1, dims + 1)], each)


def _slot(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie at or below the value, by halving: a few comparisons, all compiled."""

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(cuts[mid]), halve(mid + 1, hi)).otherwise(halve(lo, mid))

    return halve(0, len(cuts))


def _tile(slots: list[Column]) -> Column:
    out = F.lit(0)
    for s in slots:
        out = out * CUTS + s
    return out.cast("int")


def box_join(points: DataFrame, boxes: DataFrame, dims: list[str], cuts: list[list[float]] | None = None) -> DataFrame:
    """Points and boxes (qid, lo1.., hi1..) that hold them, both ends closed. Inverted boxes hold nothing."""
    d = range(len(dims))
    cuts = cuts if cuts is not None else box_cuts(boxes, len(dims))
    listed = boxes.where(" and ".join(f"lo{k + 1} <= hi{k + 1}" for k in d))
    for k in d:
        listed = listed.withColumn(f"__t{k}", F.explode(F.sequence(_slot(F.col(f"lo{k + 1}"), cuts[k]), _slot(F.col(f"hi{k + 1}"), cuts[k]))))
    listed = listed.withColumn("__tile", _tile([F.col(f"__t{k}") for k in d])).drop(*(f"__t{k}" for k in d))
    met = points.withColumn("__tile", _tile([_slot(F.col(c), cuts[k]) for k, c in enumerate(dims)])).join(listed, "__tile")
    for k, c in enumerate(dims):
        met = met.where(F.col(c).between(F.col(f"lo{k + 1}"), F.col(f"hi{k + 1}")))
    return met.drop("__tile")


def range_rows(points: DataFrame, boxes: DataFrame, dims: list[str]) -> DataFrame:
    """(qid, point columns)."""
    return box_join(points, boxes, dims).select("qid", *points.columns)


def range_counts(points: DataFrame, boxes: DataFrame, dims: list[str]) -> DataFrame:
    """(qid, n) for every box, 0 for those that hold nothing."""
    found = box_join(points.select(*dims), boxes, dims).groupBy("qid").agg(F.count("*").alias("n"))
    return boxes.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def brute_counts(points: DataFrame, boxes: DataFrame, dims: list[str]) -> DataFrame:
    """The same by comparing blocks of places with every box of a stated query set, which each task holds; for tests and baselines.

    Points at one place are compared once and count as often as they stand there; so are equal boxes. A box that a block's bounds lie
    in counts all of it, one that they miss nothing; all others are compared with every place of the block.
    """
    sides = [f"{s}{k}" for s in ("lo", "hi") for k in range(1, len(dims) + 1)]
    asked = stage(boxes.where(" and ".join(f"{c} is not null" for c in sides)).select(*sides).distinct())
    own = {c: v.to_numpy() for c, v in zip(sides, asked.toArrow().columns)}
    lows, highs = ([own[f"{s}{k}"] for k in range(1, len(dims) + 1)] for s in ("lo", "hi"))
    highs = [np.where(np.isnan(v), np.inf, v) for v in highs]  # in SQL, no number is above NaN

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own[sides[0]]), np.int64)
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                at, n = [part.column(c).to_numpy() for c in dims], part.column("n").to_numpy()
                meets, holds = np.ones(len(total), bool), np.ones(len(total), bool)
                for x, lo, hi in zip(at, lows, highs):
                    meets &= (lo <= x.max()) & (hi >= x.min())
                    holds &= (lo <= x.min()) & (hi >= x.max())
                total[holds] += n.sum()
                rest = np.flatnonzero(meets & ~holds)
                for some in np.split(rest, range(2048, len(rest), 2048)):
                    inside = np.ones((len(some), len(n)), bool)
                    for x, lo, hi in zip(at, lows, highs):
                        inside &= (lo[some, None] <= x) & (hi[some, None] >= x)
                    total[some] += inside @ n
        at = np.flatnonzero(total)
        for part in np.split(at, range(10_000, len(at), 10_000)):
            yield pa.RecordBatch.from_arrays([*(pa.array(own[c][part]) for c in sides), pa.array(total[part])], names=[*sides, "n"])

    met = along(stage(counted(points, dims)), dims).mapInArrow(scan, f"{', '.join(f'{c} double' for c in sides)}, n long")
    found = met.groupBy(*sides).agg(F.sum("n").alias("n"))
    return boxes.join(found, sides, "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pages_touched(paged: DataFrame, boxes: DataFrame, dims: list[str]) -> DataFrame:
    """(qid, n, n_pages): points in each box and the pages that hold them."""
    found = box_join(paged, boxes, dims).groupBy("qid", "page_no").agg(F.count("*").alias("c")).groupBy("qid").agg(F.sum("c").alias("n"), F.count("*").alias("n_pages"))
    zero = F.lit(0).cast("long")
    return boxes.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", zero).alias("n"), F.coalesce("n_pages", zero).alias("n_pages"))


def range_by_index(paged: DataFrame, bounds: DataFrame, boxes: DataFrame, grid: Grid) -> DataFrame:
    """(qid, n, n_pages): points in each box, found through the index, and the pages that the index visits for it.

    The cells of a box give key intervals, these the pages whose key ranges they meet; the points of those pages are tested.
    """
    config = grid.config
    visited = stage(pages_in_intervals(cell_intervals(boxes, grid), bounds, float(config.parts)))
    met = paged.join(visited, "page_no").join(boxes, "qid")
    for k, c in enumerate(config.axes):
        met = met.where(F.col(c).between(F.col(f"lo{k + 1}"), F.col(f"hi{k + 1}")))
    found = met.groupBy("qid").agg(F.count("*").alias("n"))
    pages = visited.groupBy("qid").agg(F.count("*").alias("n_pages"))
    zero = F.lit(0).cast("long")
    return boxes.select("qid").join(pages, "qid", "left").join(found, "qid", "left").select("qid", F.coalesce("n", zero).alias("n"), F.coalesce("n_pages", zero).alias("n_pages"))


def cell_intervals(boxes: DataFrame, grid: Grid) -> DataFrame:
    """(qid, cell, low, high): for each cell that a box overlaps, the keys of its two corners within the cell."""
    config = grid.config
    out = boxes.where(" and ".join(f"lo{k} <= hi{k}" for k in range(1, config.dims + 1))).withColumn("cell", F.lit(0).cast("long"))
    for k in range(config.dims - 1):
        own = grid.splits.where(F.col("level") == k).select("parent", (F.col("parent") * config.parts + F.col("part")).alias("child"), F.col("lb").alias(f"front_{k}"), F.col("ub").alias(f"back_{k}"))
        lo, hi = F.col(f"lo{k + 1}"), F.col(f"hi{k + 1}")
        first = F.col(f"front_{k}") == 0
        last = F.col(f"back_{k}") == config.hi
        # half-open strips; what lies outside the domain belongs to the outer strips
        meets = ((hi >= F.col(f"front_{k}")) | first) & ((lo < F.col(f"back_{k}")) | last)
        out = out.join(own, (F.col("cell") == F.col("parent")) & meets).drop("cell", "parent").withColumnRenamed("child", "cell")
        out = out.withColumn(f"a{k + 1}", F.greatest(lo, F.col(f"front_{k}"))).withColumn(f"b{k + 1}", F.least(hi, F.col(f"back_{k}")))
    d = config.dims
    out = out.withColumn(f"a{d}", F.col(f"lo{d}")).withColumn(f"b{d}", F.col(f"hi{d}"))
    low, high = (key_of(config, [f"{s}{k}" for k in range(1, d + 1)]) for s in "ab")
    return out.select("qid", "cell", low.alias("low"), high.alias("high"))


def union_intervals(intervals: DataFrame, gap: float = 1e-5) -> DataFrame:
    """(qid, low, high): intervals of a query less than ``gap`` apart become one."""
    w = Window.partitionBy("qid").orderBy("low", "high")  # cells of a box
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(F.col("low") - before < gap, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(w))
    return island.groupBy("qid", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def pages_in_intervals(intervals: DataFrame, bounds: DataFrame, width: float) -> DataFrame:
    """(qid, page_no): pages whose key range meets an interval, by an equi-join on stretches of ``width`` of the key."""
    slot = lambda c: F.floor(c / width).cast("long")
    a = intervals.withColumn("slot", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))))
    b = bounds.select("page_no", F.col("low").alias("from"), F.col("high").alias("to")).withColumn("slot", F.explode(F.sequence(slot(F.col("from")), slot(F.col("to")))))
    return a.join(b, "slot").where("from <= high and to >= low").select("qid", "page_no").distinct()


def distance(dims: list[str], center: list[str]) -> Column:
    out = F.lit(0.0)
    for c, q in zip(dims, center):
        out = out + (F.col(c) - F.col(q)) * (F.col(c) - F.col(q))
    return F.sqrt(out)


def in_spheres(points: DataFrame, spheres: DataFrame, dims: list[str]) -> DataFrame:
    """Columns of both and ``dist`` for the points within ``r`` of each sphere (c1.., r), boundary included."""
    d = len(dims)
    boxes = spheres.withColumns({f"lo{k}": F.col(f"c{k}") - F.col("r") for k in range(1, d + 1)} | {f"hi{k}": F.col(f"c{k}") + F.col("r") for k in range(1, d + 1)})
    found = box_join(points, boxes, dims).withColumn("dist", distance(dims, [f"c{k}" for k in range(1, d + 1)]))
    return found.where("dist <= r").drop(*(f"{s}{k}" for s in ("lo", "hi") for k in range(1, d + 1)))


def sphere_rows(points: DataFrame, spheres: DataFrame, dims: list[str], digits: int | None = None) -> DataFrame:
    """(qid, point columns, dist) of the points within ``r`` of each sphere (qid, c1.., r), boundary included; ``digits``: of dist.

    Places meet the distinct spheres; the rows of both are dealt out behind the join.
    """
    spots = stage(gathered(points, dims, "__rows"))
    asked = stage(gathered(spheres.select("qid", *(f"c{k}" for k in range(1, len(dims) + 1)), "r"), [*(f"c{k}" for k in range(1, len(dims) + 1)), "r"], "__asked"))
    met = in_spheres(spots, asked, dims).withColumn("dist", F.col("dist") if digits is None else F.round("dist", digits))
    return met.select("__asked", *dims, "dist", F.inline("__rows")).select(*dims, *(c for c in points.columns if c not in dims), "dist", F.inline("__asked")).select("qid", *points.columns, "dist")


def sphere_counts(points: DataFrame, spheres: DataFrame, dims: list[str]) -> DataFrame:
    """(qid, n) for every sphere; places meet the distinct spheres and count as often as points stand there."""
    own = [*(f"c{k}" for k in range(1, len(dims) + 1)), "r"]
    found = in_spheres(counted(points, dims), stage(spheres.select(*own).distinct()), dims).groupBy(*own).agg(F.sum("n").alias("n"))
    return spheres.join(found, own, "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dominated_counts(points: DataFrame, corners: DataFrame, dims: list[str]) -> DataFrame:
    """(qid, n): points at or below each corner (qid, hi1..) in every dimension.

    In two dimensions nothing is joined but the strip of the first one that a corner lies in: of every strip before it the points
    at or below the corner are its rank by the second dimension. Strips come in blocks, so a corner asks for two square roots of
    their number. In other numbers of dimensions, corners are boxes without a lower end, which meet every point they hold.
    """
    if len(dims) != 2:
        open_ = corners.withColumns({f"lo{k}": F.lit(float("-inf")) for k in range(1, len(dims) + 1)})
        return range_counts(points, open_.select("qid", *(f"lo{k}" for k in range(1, len(dims) + 1)), *(f"hi{k}" for k in range(1, len(dims) + 1))), dims)
    x, y = dims
    spots = stage(counted(points, dims))
    strips = Strips.of(spots, x)
    wide = math.ceil(math.sqrt(strips.count))
    placed = spots.withColumn("__s", strips.at(x))
    asked = stage(known(corners, ["hi1", "hi2"]).select("hi1", "hi2").distinct().withColumn("__s", strips.at("hi1")))
    block = F.floor(F.col("__s") / wide).cast("int")
    upto = lambda a, b: F.explode(F.filter(F.sequence(a, F.greatest(a, b)), lambda v: v <= b))
    none = F.lit(None).cast("double")
    ranked = None
    for level, of, first, last in ((0, block, F.lit(0), block - 1), (1, F.col("__s"), block * wide, F.col("__s") - 1 + F.col("__s") % 2)):
        held = placed.select(F.lit(level).alias("level"), of.alias("strip"), F.col(y).alias("at"), F.lit(0).alias("kind"), "n", none.alias("hi1"), none.alias("hi2"))
        wanted = asked.select(F.lit(level).alias("level"), upto(first, last).alias("strip"), F.col("hi2").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "hi1", "hi2")
        ranked = held.unionByName(wanted) if ranked is None else ranked.unionByName(held).unionByName(wanted)
    w = Window.partitionBy("level", "strip").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ranked.withColumn("n", F.sum("n").over(w)).where("kind = 1").select("hi1", "hi2", "n")
    own = placed.where("__s % 2 = 0").join(asked, "__s").where((F.col(x) <= F.col("hi1")) & (F.col(y) <= F.col("hi2"))).select("hi1", "hi2", "n")
    found = before.unionByName(own).groupBy("hi1", "hi2").agg(F.sum("n").alias("n"))
    return corners.join(found, ["hi1", "hi2"], "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
