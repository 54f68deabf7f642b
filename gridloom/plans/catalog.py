"""The named queries of the engine over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import columns, dml, grid, knn, lattice, layout, metrics, order, places, prep, ranges
from ..operators.index import Index
from ..sources import files
from ..sources import points as sources
from .config import GridConfig
from .staging import folder, stage

CONFIG = GridConfig(parts=10, models=16, sigma=8, page_size=50)
CONFIG3 = GridConfig(dims=3, parts=6, models=16, sigma=8, page_size=50)
HI = 10000.0
XY = ["x1", "x2"]
K = 10


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    """events as points: (pid, x1 = value, x2 = user_id), rescaled."""
    return prep.rescale(sources.from_table(_read(spark, d, "events"), "event_id", ["value", "user_id"]), XY)


def ev3(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "events").withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return prep.rescale(sources.from_table(own, "event_id", ["value", "second", "user_id"]), ["x1", "x2", "x3"])


def ordp(spark: SparkSession, d: str) -> DataFrame:
    """orders as points: (pid, x1 = price, x2 = days)."""
    own = _read(spark, d, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
    return prep.rescale(sources.from_table(own, "o_orderkey", ["o_totalprice", "day"]), XY)


def li(spark: SparkSession, d: str, names: tuple[str, ...] = ("l_extendedprice", "l_quantity")) -> DataFrame:
    own = _read(spark, d, "lineitem").select(*(F.col(c).cast("double").alias(f"x{k + 1}") for k, c in enumerate(names)))
    return prep.rescale(own, own.columns)


#: The query set of every search: the rows whose id this divides.
EVERY = 50


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return ordp(spark, d).where(F.col("pid") % EVERY == 0)


def boxes(spark: SparkSession, d: str, half: float = 50.0) -> DataFrame:
    """A box around each order of the query set, written once: a search reads it several times."""
    sides = {f"lo{k}": F.col(f"x{k}") - half for k in (1, 2)} | {f"hi{k}": F.col(f"x{k}") + half * 3 for k in (1, 2)}
    return stage(_asked(spark, d).select(F.col("pid").alias("qid"), *(e.alias(c) for c, e in sides.items())))


def spheres(spark: SparkSession, d: str, r: float = 150.0) -> DataFrame:
    return stage(_asked(spark, d).select(F.col("pid").alias("qid"), F.col("x1").alias("c1"), F.col("x2").alias("c2"), F.lit(r).alias("r")))


def centers(spark: SparkSession, d: str) -> DataFrame:
    return spheres(spark, d).drop("r")


@dataclass
class Built:
    """An index of the events."""

    grid: grid.Grid
    ranks: DataFrame
    starts: list[float]
    placed: DataFrame
    stats: DataFrame
    pairs: DataFrame

    @staticmethod
    def of(spark: SparkSession, d: str) -> Built:
        pts = ev(spark, d)
        g = grid.build_grid(pts, CONFIG)
        ranks = stage(grid.ordered(g.keyed(pts)))
        starts = columns.boundaries(ranks, CONFIG)
        placed = columns.with_columns_of(ranks, starts)
        stats = stage(columns.column_stats(placed, CONFIG))
        return Built(g, ranks, starts, placed, stats, columns.training_pairs(placed, stats))

    @property
    def weights(self) -> DataFrame:
        return columns.interpolate(columns.knots(self.pairs, CONFIG), self.stats)

    def numbered(self) -> DataFrame:
        return layout.number_shards(layout.shards(self.placed, stage(self.weights), CONFIG))

    def paged(self) -> DataFrame:
        own = stage(self.numbered())
        return layout.pages(own, layout.shard_table(own, CONFIG), CONFIG)


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in names]


def _q_splits3(s, d):
    return grid.build_grid(ev3(s, d), CONFIG3).splits.select("level", "parent", "part", *_r("lb", "ub"))


def _q_range_rows(s, d):
    return ranges.range_rows(ordp(s, d), boxes(s, d, 20.0), XY).select("qid", "pid", *_r(*XY))


def _q_range_4d(s, d):
    own = li(s, d, ("l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    return ranges.range_counts(own, s.createDataFrame(BOXES_4D, "qid long, lo1 double, lo2 double, lo3 double, lo4 double, hi1 double, hi2 double, hi3 double, hi4 double"), ["x1", "x2", "x3", "x4"])


def _q_recall(s, d):
    asked = centers(s, d)
    found = stage(knn.knn_box(ev(s, d), asked, K, XY, 100.0))
    return metrics.recall(found, knn.knn(ev(s, d), asked, K, XY), ["qid", "rank"]).select(*_r("recall"))


def _batch(s, d):
    return ev(s, d).where("pid % 10 = 3").withColumn("pid", F.col("pid") + 10_000_000)


def _targets(s, d):
    """Coordinates of a tenth of the events, a few of them twice, and one that no event has."""
    own = ev(s, d)
    twice = own.where("pid % 10 = 4").unionByName(own.where("pid % 50 = 4"))
    return twice.select(*XY).unionByName(s.createDataFrame([(-1.0, -1.0)], "x1 double, x2 double"))


def _q_insert_range(s, d):
    return ranges.range_counts(dml.insert(ev(s, d), _batch(s, d)), boxes(s, d, 100.0), XY)


def _q_roundtrip(s, d):
    both = dml.delete(dml.insert(ev(s, d), _batch(s, d)), _batch(s, d), XY)
    return both.agg(F.count("*").alias("n"), F.count_distinct("x1", "x2").alias("n_distinct"))


def _q_lookup(s, d, single=False):
    b = Built.of(s, d)
    own = stage(b.numbered())
    table = layout.shard_table(own, CONFIG)
    weights = stage(b.weights)
    find = lambda flag: layout.shard_at(layout.lookup(b.ranks.select("pid", "key"), weights, table, b.starts, flag), CONFIG)
    return own, find


def _q_lookup_check(s, d):
    _, find = _q_lookup(s, d)
    return find(False).select("pid", "shard_id")


def _q_float(s, d):
    _, find = _q_lookup(s, d)
    return metrics.mismatch(find(False), find(True), ["pid"], "shard_id")


def _q_train(s, d):
    b = Built.of(s, d)
    base = columns.losses(b.pairs, b.weights).withColumnRenamed("loss", "base")
    fitted = stage(columns.train(b.pairs, b.stats, CONFIG))
    better = columns.losses(b.pairs, fitted).join(fitted.select("col_id", columns.is_valid().alias("valid")), "col_id")
    return base.join(better, "col_id").select("col_id", *_r("base", "loss", digits=3), "valid")


def _q_mlp(s, d):
    b = Built.of(s, d)
    return columns.train_mlp(b.pairs).select("col_id", F.size("parameters").alias("n_parameters"), *_r("loss", digits=3))


def _q_intervals(s, d):
    g = Built.of(s, d).grid
    return ranges.cell_intervals(boxes(s, d, 100.0), g).select("qid", "cell", *_r("low", "high"))


def _q_union(s, d):
    g = Built.of(s, d).grid
    own = boxes(s, d, 100.0).withColumns({"lo2": F.lit(0.0), "hi2": F.lit(HI)})
    return ranges.union_intervals(ranges.cell_intervals(own, g), 2.0).select("qid", *_r("low", "high"))


def _q_lattice(s, d):
    fitted = stage(lattice.radius_model(ev(s, d), XY, K, 8, 0.0, HI, 200))
    return lattice.predict(lattice.corner_weights(ev(s, d), XY, 8, 0.0, HI), fitted).select("pid", *_r("y"))


def _q_predict(s, d):
    own = ev(s, d)
    plane = lattice.nodes(s, 11, 2, 0.0, HI).select("node_id", (F.col("c1") * 2 + F.col("c2") + 1).alias("b"))
    return lattice.predict(lattice.corner_weights(own, XY, 11, 0.0, HI), plane).select("pid", F.round("y", 4).alias("y"))


def _q_shards(s, d):
    return Built.of(s, d).numbered().groupBy("shard_id", "col_id").agg(F.count("*").alias("n"))


def _q_pages_touched(s, d):
    return ranges.pages_touched(Built.of(s, d).paged().select("pid", *XY, "page_no"), boxes(s, d, 100.0), XY)


def _q_metrics(s, d):
    wide = _read(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").cast("double").alias("n"), F.avg("n_nationkey").alias("mean"), F.stddev_pop("n_nationkey").alias("std"))
    return metrics.to_long(wide, ["n_regionkey"]).select("n_regionkey", "metric", F.round("value", 6).alias("value"))


def _q_placed(s, d):
    b = Built.of(s, d)
    return dml.insert_placed(b.placed, _batch(s, d), b.grid, b.starts).groupBy("col_id").agg(F.count("*").alias("n"))


def _q_report(s, d):
    return metrics.report(_q_metrics(s, d).withColumn("value", F.when(F.col("metric") == "std", -1.0).otherwise(F.col("value"))), "n_regionkey", "metric", "value")


def _q_text(s, d):
    own = _read(s, d, "nation").select("n_name", F.array(F.col("n_name"), F.lit(None).cast("string"), F.lit("x")).alias("items"))
    return own.select("n_name", text.join_items(F.col("items")).alias("joined"), text.strip_pound(F.concat(F.lit("#"), "n_name")).alias("stripped"), text.is_punctuation(F.lit("?!")).alias("marks"), text.matches(F.col("n_name"), "[A-M]").alias("early"))


def _q_radius(s, d):
    return knn.kth_radius(ev(s, d), ev(s, d).where(F.col("pid") % EVERY == 0), 5, XY).select("pid", *_r("radius"))


def _q_vectors(s, d):
    own = _read(s, d, "embeddings")
    return knn.knn_vectors(own, own.where(F.col("vec_id") % EVERY == 0), 5).select("qid", "rank", "vec_id", F.round("dist2", 6).alias("dist2"))


def _q_mappings(s, d):
    paged = stage(Built.of(s, d).paged())
    return layout.page_of(paged.select("pid", "key", "shard_id"), layout.page_bounds(paged)).select("pid", "page_no")


def _q_by_index(s, d):
    b = Built.of(s, d)
    paged = stage(b.paged())
    return ranges.range_by_index(paged.select("page_no", *XY), layout.page_bounds(paged), boxes(s, d, 100.0), b.grid)


def _q_pages_in(s, d):
    b = Built.of(s, d)
    return ranges.pages_in_intervals(ranges.cell_intervals(boxes(s, d, 100.0), b.grid), layout.page_bounds(b.paged()), float(CONFIG.parts))


def _q_insert_shards(s, d):
    b = Built.of(s, d)
    own, weights = stage(b.numbered()), stage(b.weights)
    _, table = dml.insert_shards(own, b.grid.keyed(_batch(s, d)), weights, layout.shard_table(own, CONFIG), b.starts, CONFIG)
    return table.select("shard_id", "n", "start", "n_pages", "first_page")


def _q_delete_near(s, d):
    near = ev(s, d).where("pid % 10 = 4").select(*(F.col(c) + F.lit(4e-8) for c in XY)).toDF(*XY)
    far = ev(s, d).where("pid % 10 = 5").select(*(F.col(c) + F.lit(3e-7) for c in XY)).toDF(*XY)
    return dml.delete(ev(s, d), near.unionByName(far), XY, tolerance=1e-7).select("pid")


def _reloaded(s, d):
    path = folder(s, "index")
    Index.build(ev(s, d), CONFIG).save(path)
    return Index.load(s, path)


def _q_index_update(s, d):
    grown = _reloaded(s, d).insert(_batch(s, d))
    return grown.delete(ev(s, d).where("pid % 10 = 4").select(*XY)).box(boxes(s, d, 100.0)).select("qid", "n")


def _q_knn_radius(s, d):
    # the fit leaves out the point itself, so it takes one more
    spots = stage(places.least_keys(ev(s, d), XY, "pid", K + 1))
    fitted = lattice.cached_radius_model(ev(s, d), XY, K, 8, 0.0, HI, folder(s, "lattice"), per_node=5, spots=spots)
    return lattice.knn_by_radius(ev(s, d), centers(s, d), K, XY, fitted, 8, 0.0, HI, spots=spots).select("qid", "rank", "pid", *_r("dist"))


def _q_csv(s, d):
    path = folder(s, "csv")
    metrics.write_csv(ev(s, d).select(*XY), path)
    return sources.read_csv(s, path).select(*_r(*XY))


def _q_boxes_text(s, d):
    path, names = folder(s, "boxes"), ["lo1", "lo2", "hi1", "hi2"]
    metrics.write_text(boxes(s, d), names, path)
    return files.read_boxes(s, path, 2).select(*_r(*names, digits=4))


def _q_map(s, d):
    path = folder(s, "map")
    files.write_map(_read(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), path)
    return files.read_map(s, path, key="long", turned=True)


def _q_bootstrap(s, d):
    own = prep.bootstrap(ev(s, d), 500, XY, jitter=0.0)
    return own.join(ev(s, d).select(*XY).distinct(), XY).agg(F.count("*").alias("n"))


BOXES_4D = [
    (k, *(float(v) for v in line.split()))
    # The example query boxes, lows then highs
    for k, line in enumerate(
        """6370.2059181896 3248.8291580511 7845.8387280803 1759.0211977382 7755.0581403380 4960.9875153527 9491.4106881736 3671.4264961232
2151.6006660892 8389.9032611536 2762.1441391763 867.7939981486 4106.8599883745 9492.4871759617 4116.1858998680 2150.2318545585
5612.4466452222 6678.8294266954 8753.3303878604 1146.5867557875 7151.4539539309 7869.4944934829 9995.0000000000 2404.6532586463
3185.3352592305 2324.6040919287 8157.5512054337 4510.2187706456 4206.3731633012 3369.2334973340 9540.8937191720 6245.8289116773
6798.3669290094 7551.3395638685 1067.3563350963 5235.7342668712 8152.2010485787 9430.9453197385 2846.5291878453 6633.8979639219
3262.7152967100 7024.3332815239 1867.8176215502 6795.1530301409 4693.5953538659 8679.4605018989 3092.8780701847 7991.1089547401
7689.1782087514 4270.2495619397 6476.2151396581 8175.9728885682 8698.5156324401 6031.3180956714 7858.8431194530 9995.0000000000
3513.1528880987 2379.7031804722 3535.7228122998 7558.4910960560 5036.9942098450 3621.9983831958 5449.5732890925 8967.3254016879
1512.2380370109 1349.5958324774 2235.7180260541 5300.3359447170 3221.4318182696 3053.7225154982 3305.2447756570 7159.8206881329
7476.3084925315 266.1525235759 8404.3646345540 5205.2243402778 8608.9891064588 2088.5903754629 9770.7451687295 6758.6111588778""".splitlines()
    )
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    b = Built.of
    return {
        "range_count": lambda s, d: ranges.range_counts(li(s, d), boxes(s, d), XY),
        "range_rows": _q_range_rows,
        "range_count_with_zero": lambda s, d: ranges.range_counts(ordp(s, d), boxes(s, d, -60.0), XY),
        "range_avg_match": lambda s, d: ranges.range_counts(ordp(s, d), boxes(s, d), XY).agg(F.round(F.avg("n"), 6).alias("avg_match"), F.count("*").alias("n_queries")),
        "range_count_4d": _q_range_4d,
        "range_brute": lambda s, d: ranges.brute_counts(ordp(s, d), boxes(s, d, 20.0), XY),
        "sphere_rows": lambda s, d: ranges.sphere_rows(ordp(s, d), spheres(s, d), XY, digits=6).select("qid", "pid", "dist"),
        "sphere_count": lambda s, d: ranges.sphere_counts(ordp(s, d), spheres(s, d), XY),
        "knn_exact": lambda s, d: knn.knn(ordp(s, d), centers(s, d), K, XY).select("qid", "rank", "pid", *_r("dist")),
        "knn_brute": lambda s, d: knn.brute(ev(s, d), centers(s, d), K, XY).select("qid", "rank", "pid", *_r("dist")),
        "knn_kth_radius": _q_radius,
        "knn_box_variant": lambda s, d: knn.knn_box(ev(s, d), centers(s, d), K, XY, 100.0).select("qid", "rank", *_r("dist")),
        "knn_embeddings": _q_vectors,
        "recall_at_k": _q_recall,
        "upper_bound_count": lambda s, d: ranges.dominated_counts(ordp(s, d), boxes(s, d, 20.0).select("qid", "hi1", "hi2"), XY),
        "knn_within_radius": lambda s, d: knn.within(ordp(s, d), spheres(s, d), 5, XY).select("qid", "rank", *_r("dist")),
        "knn_doubling_radius": lambda s, d: knn.doubling_radius(ordp(s, d), centers(s, d), K, XY, 50.0),
        "rescale_minmax": lambda s, d: ev(s, d).select("pid", *_r(*XY)),
        "dedupe_points": lambda s, d: prep.dedupe(li(s, d), XY, 3),
        "clip_points": lambda s, d: prep.clip_points(ev(s, d), XY, 1000.0, 9000.0).select("pid", *_r(*XY)),
        "drop_nan": lambda s, d: prep.drop_missing(ev(s, d).withColumn("x2", F.when(F.col("pid") % 7 == 0, float("nan")).when(F.col("pid") % 11 == 0, None).otherwise(F.col("x2"))), XY).select("pid", *_r(*XY)),
        "split_static_insert_delete": lambda s, d: prep.split_sets(ordp(s, d)).select("pid", "is_static", "is_insert", "is_delete"),
        "axis_product": lambda s, d: prep.product([_read(s, d, "region").select("r_regionkey"), _read(s, d, "nation").select("n_nationkey")]),
        "grid_splits": lambda s, d: grid.build_grid(ev(s, d), CONFIG).splits.select("part", *_r("lb", "ub")),
        "grid_splits_3d": _q_splits3,
        "last_dim_splits": lambda s, d: grid.last_splits(ev(s, d), CONFIG).select("part", *_r("lb", "ub")),
        "cell_borders": lambda s, d: grid.borders(grid.build_grid(ev(s, d), CONFIG)).select("cell", *_r("front_0", "back_0", "measure")),
        "monotone_key": lambda s, d: grid.build_grid(ev(s, d), CONFIG).keyed(ev(s, d)).select("pid", "cell", *_r("key")),
        "key_rank": lambda s, d: b(s, d).ranks.select("pid", "rank"),
        "key_order_check": lambda s, d: order.count_inversions(b(s, d).ranks.select("rank", "key").withColumnRenamed("rank", "place"), ["place"], "key"),
        "column_boundaries": lambda s, d: (lambda x: s.createDataFrame([(i + 1, v) for i, v in enumerate(x.starts)], "col_id long, boundary double").select("col_id", *_r("boundary")))(b(s, d)),
        "column_stats": lambda s, d: b(s, d).stats.select("col_id", "n", F.col("end").alias("cum_n"), *_r("min_key")),
        "train_pairs": lambda s, d: b(s, d).pairs.select("col_id", "pos", *_r("t")),
        "knots": lambda s, d: columns.knots(b(s, d).pairs, CONFIG).select("col_id", "i", "pos", *_r("beta")),
        "knot_predict": lambda s, d: (lambda x: x.pairs.join(x.weights.select("col_id", "alphas", "betas"), "col_id").select("col_id", "pos", F.round(columns.predict(F.col("t")), 4).alias("predicted")))(b(s, d)),
        "model_loss": lambda s, d: (lambda x: columns.losses(x.pairs, x.weights).select("col_id", F.round("loss", 3).alias("loss")))(b(s, d)),
        "model_valid": lambda s, d: b(s, d).weights.select("col_id", columns.is_valid().alias("valid")),
        "shard_layout": _q_shards,
        "shard_assign": lambda s, d: b(s, d).numbered().select("pid", "shard_id"),
        "shards_per_column": lambda s, d: layout.shards_per_column(layout.shard_table(b(s, d).numbered(), CONFIG)),
        "rebuild_order": lambda s, d: layout.rebuilt(b(s, d).paged()).select("pid", "place"),
        "page_assign": lambda s, d: b(s, d).paged().select("pid", "page_no"),
        "page_split_keys": lambda s, d: layout.split_keys(b(s, d).paged()).select("shard_id", "page_no", *_r("split_key")),
        "page_lookup": _q_mappings,
        "flat_offsets": lambda s, d: layout.shard_table(b(s, d).numbered(), CONFIG).select("shard_id", "start", "stop"),
        "lookup_exact": _q_lookup_check,
        "lookup_float_mismatch": _q_float,
        "range_pages_touched": _q_pages_touched,
        "range_by_index": _q_by_index,
        "pages_in_intervals": _q_pages_in,
        "range_cell_intervals": _q_intervals,
        "interval_union": _q_union,
        "insert_batch": lambda s, d: dml.insert(ev(s, d), _batch(s, d)).select("pid", *_r(*XY)),
        "insert_then_range": _q_insert_range,
        "insert_placed": _q_placed,
        "insert_shards": _q_insert_shards,
        "index_reload_range": lambda s, d: _reloaded(s, d).box(boxes(s, d, 100.0)),
        "index_update_range": _q_index_update,
        "knn_by_radius": _q_knn_radius,
        "dominance_check": lambda s, d: order.count_dominated(b(s, d).ranks, ["rank"], XY),
        "split_order_check": lambda s, d: order.count_flat_splits(grid.build_grid(ev(s, d), CONFIG).splits),
        "csv_points": _q_csv,
        "text_boxes": _q_boxes_text,
        "text_map": _q_map,
        "bootstrap_points": _q_bootstrap,
        "delete_tolerance": _q_delete_near,
        "delete_batch": lambda s, d: dml.delete(ev(s, d), ev(s, d).where("pid % 10 = 4"), XY).groupBy(*(F.round(c, 6).alias(c) for c in XY)).agg(F.count("*").alias("n")),
        "delete_batch_dups": lambda s, d: dml.delete(ev(s, d), _targets(s, d), XY).select("pid"),
        "insert_delete_roundtrip": _q_roundtrip,
        "lattice_nodes": lambda s, d: lattice.nodes(s, 11, 2, 0.0, HI),
        "laplacian": lambda s, d: lattice.laplacian(s, 11, 2).select("a", "b", *_r("value", digits=9)),
        "corner_weights": lambda s, d: lattice.corner_weights(ev(s, d), XY, 11, 0.0, HI).select("pid", "node_id", *_r("w")),
        "lattice_predict": _q_predict,
        "lattice_train": _q_lattice,
        "cdf_train": _q_train,
        "mlp_train": _q_mlp,
        "metrics_unpivot": _q_metrics,
        "metrics_report": _q_report,
        "text_helpers": _q_text,
    }
