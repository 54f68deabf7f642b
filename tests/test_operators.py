"""Edge cases and properties of the spatial operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import columns, dml, grid, knn, lattice, layout, order, ranges
from gridloom.operators.index import Index
from gridloom.plans import harness
from gridloom.plans.config import GridConfig
from gridloom.sources import files, points
from gridloom.streaming.inserts import insert_stream


def frame(spark, rows, dims=2):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "pid long, " + ", ".join(f"x{k + 1} double" for k in range(dims)))


def cloud(n, dims=2, seed=42, top=1000.0):
    return np.random.default_rng(seed).uniform(0, top, (n, dims))


def box_frame(spark, boxes, dims=2):
    names = [f"lo{k}" for k in range(1, dims + 1)] + [f"hi{k}" for k in range(1, dims + 1)]
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "qid long, " + ", ".join(f"{n} double" for n in names))


def test_box_edges(spark):
    pts = cloud(300, top=100.0).tolist() + [[50.0, 50.0]] * 5 + [[100.0, 100.0]] * 40
    boxes = [(50, 50, 50, 50), (0, 0, 100, 100), (60, 60, 50, 70), (200, 200, 300, 300), (-10, -10, 0, 0), (100, 100, 100, 100), (-1e9, -1e9, 1e9, 1e9)]
    got = {r.qid: r.n for r in ranges.range_counts(frame(spark, pts), box_frame(spark, boxes), ["x1", "x2"]).collect()}
    assert got == {i: sum(a <= x <= c and b <= y <= d for x, y in pts) for i, (a, b, c, d) in enumerate(boxes)}
    none = ranges.range_counts(frame(spark, [[1, 1]]).limit(0), box_frame(spark, boxes), ["x1", "x2"])
    assert {r.n for r in none.collect()} == {0} and none.count() == len(boxes)


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_boxes_in_any_dimension(spark, dims):
    pts, r = cloud(1500, dims).tolist(), random.Random(dims)
    boxes = []
    for _ in range(15):
        lo = [r.uniform(0, 700) for _ in range(dims)]
        boxes.append((*lo, *(v + r.uniform(50, 600) for v in lo)))
    names = [f"x{k + 1}" for k in range(dims)]
    got = {x.qid: x.n for x in ranges.range_counts(frame(spark, pts, dims), box_frame(spark, boxes, dims), names).collect()}
    assert got == {i: sum(all(b[k] <= p[k] <= b[dims + k] for k in range(dims)) for p in pts) for i, b in enumerate(boxes)}


def test_knn_is_exact(spark):
    pts = cloud(800).tolist() + [[5.0, 5.0]] * 30
    asked = [(5.0, 5.0), (500.0, 500.0), (-4000.0, 9000.0), (999.0, 1.0)]
    q = spark.createDataFrame([(i, *c) for i, c in enumerate(asked)], "qid long, c1 double, c2 double")
    for k in (1, 7, 40, 2000):
        got = {}
        for r in knn.knn(frame(spark, pts), q, k, ["x1", "x2"]).collect():
            got.setdefault(r.qid, []).append((r.rank, r.pid))
        for i, (a, b) in enumerate(asked):
            want = sorted(range(len(pts)), key=lambda j: (math.sqrt((pts[j][0] - a) * (pts[j][0] - a) + (pts[j][1] - b) * (pts[j][1] - b)), j))[:k]
            assert [p for _, p in sorted(got[i])] == want


@pytest.mark.parametrize("n,models", [(0, 4), (1, 4), (3, 8), (997, 16)])
def test_grid_key_is_monotone_and_shards_partition(spark, n, models):
    config = GridConfig(parts=7, models=models, sigma=8, page_size=20, hi=1000.0)
    rows = cloud(n).tolist()
    if n > 100:
        rows[:300] = [[1000.0, y] for _, y in rows[:300]]
        rows[300:500] = [[250.0, y] for _, y in rows[300:500]]
    pts = frame(spark, rows) if rows else frame(spark, [[1, 1]]).limit(0)
    keyed = grid.build_grid(pts, config).keyed(pts)
    got = [(r.x1, r.x2, r.key) for r in keyed.collect()]
    assert len(got) == n and not any(math.isnan(k) for _, _, k in got)
    r = random.Random(1)
    for _ in range(3000 if n > 1 else 0):
        a, b = r.choice(got), r.choice(got)
        if a[0] <= b[0] and a[1] <= b[1]:
            assert a[2] <= b[2] + 1e-9
    if not n:
        return
    ranks = grid.ordered(keyed)
    starts = columns.boundaries(ranks, config)
    placed = columns.with_columns_of(ranks, starts)
    stats = columns.column_stats(placed, config)
    weights = columns.interpolate(columns.knots(columns.training_pairs(placed, stats), config), stats)
    numbered = layout.number_shards(layout.shards(placed, weights, config))
    table = layout.shard_table(numbered, config)
    paged = layout.pages(numbered, table, config)
    assert sorted(x.pid for x in paged.collect()) == list(range(n))
    assert all(x.n <= config.page_size for x in layout.page_bounds(paged).collect())
    spans = sorted((x.start, x.stop) for x in table.collect())
    assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_three_dimensional_grid(spark):
    config = GridConfig(dims=3, parts=5, hi=1000.0)
    pts = frame(spark, cloud(600, 3).tolist(), 3)
    g = grid.build_grid(pts, config)
    got = g.keyed(pts).collect()
    assert all(r.front_0 <= r.x1 <= r.back_0 and r.front_1 <= r.x2 <= r.back_1 for r in got)
    assert len({r.cell for r in got}) == 25
    assert abs(sum(r.measure for r in grid.borders(g).collect()) - 1000.0**2) < 1e-3


def test_rank_and_running_total(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(5), r.randrange(10)) for i in range(400)]
    df = spark.createDataFrame(rows, "pid long, g int, v int").repartition(7)
    got = {x.pid: x["rank"] for x in order.ranked(df, ["v", "pid"], ["g"]).collect()}
    for g in range(5):
        own = sorted((v, i) for i, gg, v in rows if gg == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    total = {x.pid: x.t for x in order.running_total(df, ["pid"], F.col("v"), "t").collect()}
    assert all(total[i] == sum(v for _, _, v in rows[: i + 1]) for i in range(400))
    assert order.count_inversions(df, ["pid"], "pid").first().n_inversions == 0


def test_bag_delete(spark):
    pts = frame(spark, [[1, 1], [1, 1], [1, 1], [2, 2], [3, 3]])
    gone = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (9.0, 9.0), (3.0, 3.0)], "x1 double, x2 double")
    assert sorted(r.pid for r in dml.delete(pts, gone, ["x1", "x2"]).collect()) == [2, 3]
    near = spark.createDataFrame([(2.0 + 1e-10, 2.0)], "x1 double, x2 double")
    assert sorted(r.pid for r in dml.delete(pts, near, ["x1", "x2"], tolerance=1e-9).collect()) == [0, 1, 2, 4]
    edge = frame(spark, [[3e-9, 1.0], [3e-9 + 5e-10, 1.0], [7.0, 7.0]])
    asked = spark.createDataFrame([(3e-9 - 9e-10, 1.0), (7.0 + 1.9e-9, 7.0)], "x1 double, x2 double")
    assert sorted(r.pid for r in dml.delete(edge, asked, ["x1", "x2"], tolerance=1e-9).collect()) == [1, 2]
    back = dml.delete(dml.insert(pts, pts.withColumn("pid", F.col("pid") + 10)), pts, ["x1", "x2"])
    assert sorted((r.x1, r.x2) for r in back.collect()) == sorted((r.x1, r.x2) for r in pts.collect())


def test_models_fit_and_rise(spark):
    g = np.random.default_rng(0)
    config = GridConfig(models=4, sigma=8)
    rows = []
    for c in range(4):
        t = np.sort(g.uniform(0, 100, 400)) ** (1 + c)
        rows += [(c, 400, k, float(v)) for k, v in enumerate(t - t[0])]
    rows += [(4, 50, k, 7.0 * (k >= 20)) for k in range(50)]
    pairs = spark.createDataFrame(rows, "col_id long, n long, pos long, t double")
    stats = pairs.groupBy("col_id").agg(F.count("*").alias("n"), F.min("t").alias("min_key"), F.max("t").alias("max_key"))
    base = {r.col_id: r.loss for r in columns.losses(pairs, columns.interpolate(columns.knots(pairs, config), stats)).collect()}
    fitted = columns.train(pairs, stats, config)
    better = {r.col_id: r.loss for r in columns.losses(pairs, fitted).collect()}
    assert all(better[c] <= base[c] * 1.0001 + 1e-6 for c in base) and sum(better[c] < 0.9 * base[c] for c in range(4)) >= 3
    for r in fitted.collect():
        assert np.cumsum(r.alphas).min() >= -1e-9 and (np.diff(r.betas) > 0).all()
    t = np.sort(g.uniform(0, 100, 400))
    p, loss = columns.fit_mlp(t - t[0], np.arange(400.0))
    assert np.diff(columns.mlp_outputs(p, np.linspace(0, 1, 200))).min() >= -1e-6 and loss < 400 * 400**2 / 12


def test_slopes_stay_above_zero():
    g = np.random.default_rng(1)
    for _ in range(30):
        t = np.sort(g.uniform(0, 10, 60))
        pos = g.normal(size=60).cumsum()
        betas = np.linspace(0, 9, 6)
        sums = columns.Sums.of(t, pos, betas)
        alphas = sums.solve()
        assert np.cumsum(alphas).min() >= -1e-9
        basis = np.maximum(t[:, None] - betas, 0)
        assert abs(sums.loss(alphas) - ((basis @ alphas - pos) ** 2).sum()) < 1e-6
        for _ in range(50):
            other = np.diff(np.maximum(np.cumsum(alphas) + g.normal(size=6) * 0.1, 0), prepend=0.0)
            assert sums.loss(alphas) <= sums.loss(other) + 1e-6


def test_sources(spark, tmp_path):
    for spec in ("uniform", "skewed", "zipf"):
        got = points.load_points(spark, spec, 500)
        assert got.agg(F.min("x1") >= 0, F.max("x1") <= 10000).first()[:] == (True, True) and 0 < got.count() <= 500
    with pytest.raises(ValueError):
        points.load_points(spark, "nothing")
    (tmp_path / "a.csv").write_text('lon,lat\n1.5,2\n"3",4.5\nbad,row\n')
    assert sorted((r.x1, r.x2) for r in points.read_csv(spark, f"{tmp_path}/a.csv").dropna().collect()) == [(1.5, 2.0), (3.0, 4.5)]
    assert points.malformed(points.read_csv(spark, f"{tmp_path}/a.csv")).first()[:] == (3, 1)
    (tmp_path / "n.csv").write_text("1,2\n3,4\n")
    assert [(r.x1, r.x2) for r in points.read_csv(spark, f"{tmp_path}/n.csv").collect()] == [(3.0, 4.0)]
    assert points.zipf(spark, 400, hi=30, exponent=1.5).count() == 400
    np.save(tmp_path / "a.npy", np.array([[0, 1, 7], [2, 3, 8.0]]))
    assert sorted((r.x1, r.x2) for r in points.load_points(spark, f"npy:{tmp_path}/a.npy").collect()) == [(0.0, 0.0), (10000.0, 10000.0)]
    (tmp_path / "g.txt").write_text("1\ta\tb\tc\t5.5\t6.5\n2\ta\tb\tc\tx\t6\n")
    assert [(r.x1, r.x2) for r in points.geonames(spark, f"{tmp_path}/g.txt").collect()] == [(5.5, 6.5)]
    (tmp_path / "q.txt").write_text("1 2 3 4\n5 6 7 8\n")
    assert files.read_boxes(spark, f"{tmp_path}/q.txt", 2).count() == 2
    (tmp_path / "i.ppm").write_bytes(b"P6 4 2 255\n" + bytes(range(24)))
    assert points.pixels(spark, f"{tmp_path}/i.ppm", 4).count() == 4
    files.write_map(spark.createDataFrame([("a", 1)], "key string, value int"), f"{tmp_path}/m")
    assert files.read_map(spark, f"{tmp_path}/m", turned=True, value="int").first()[:] == (1, "a")
    assert files.list_files(spark, str(tmp_path), ".npy").first().name == "a.npy"
    assert points.random_boxes(spark, 20).where("lo1 > hi1").count() == 0 and points.corner_boxes(spark, 20).where("lo2 > hi2").count() == 0


def test_index_round_trip_and_stream(spark, tmp_path):
    config = GridConfig(parts=5, models=4, sigma=4, page_size=20, hi=1000.0)
    pts = frame(spark, cloud(300).tolist())
    g = grid.build_grid(pts, config)
    ranks = grid.ordered(g.keyed(pts))
    starts = columns.boundaries(ranks, config)
    placed = columns.with_columns_of(ranks, starts)
    index = Index.build(pts, config)
    index.save(f"{tmp_path}/index")
    again = Index.load(spark, f"{tmp_path}/index")
    asked = box_frame(spark, [(100, 100, 400, 900), (0, 0, 1000, 1000), (5, 5, 4, 9)])
    want = {0: sum(100 <= x <= 400 and 100 <= y <= 900 for x, y in cloud(300)), 1: 300, 2: 0}
    assert {r.qid: r.n for r in again.box(asked).collect()} == want
    page = {r.pid: r.page_no for r in index.points.collect()}
    assert {r.pid: r.page_no for r in again.find(again.points.select("pid", "key")).collect()} == page
    more = frame(spark, cloud(200, seed=8).tolist()).withColumn("pid", F.col("pid") + 1000)
    grown = again.insert(more)
    assert grown.box(asked).where("qid = 1").first().n == 500 and grown.bounds.agg(F.max("n")).first()[0] <= 20
    less = grown.delete(more)
    assert {r.qid: r.n for r in less.box(asked).collect()} == want and sorted(r.pid for r in less.points.collect()) == list(range(300))
    frame(spark, cloud(50, seed=7).tolist()).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pts.schema).parquet(f"{tmp_path}/in")
    insert_stream(stream, g, starts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/*").count() == 50


def test_sparse_and_dense_systems_agree(monkeypatch):
    g = np.random.default_rng(3)
    a = g.normal(size=(30, 30))
    a = a @ a.T + np.eye(30)
    i, j = np.nonzero(a)
    right = g.normal(size=30)
    assert np.allclose(lattice._sparse(i, j, a[i, j], right), lattice._dense(i, j, a[i, j], right), atol=1e-6)


def test_harness_isolates_what_fails(spark, tmp_path):
    config = GridConfig(parts=5, models=4, sigma=4, page_size=20, hi=1000.0)
    pts = frame(spark, cloud(200).tolist())
    asked = box_frame(spark, [(100, 100, 400, 900), (0, 0, 1000, 1000)])

    def broken(points, config):
        raise ValueError("no")

    runs = harness.run(spark, {200: pts}, config, {"boxes": lambda p, c: harness.boxes(p, c, asked), "broken": broken, "lookup": lambda p, c: harness.lookup(p, c, 100), "batches": lambda p, c: harness.batches(p, c, (50,))})
    got = {(r.part, r.metric): r.value for r in runs.collect()}
    assert got["boxes", "differ"] == 0 and got["lookup", "exact"] == 1 and got["batches", "differ_50"] == 0
    assert got["broken", "failed: ValueError"] == -1
    harness.write_long(runs, config, f"{tmp_path}/long")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/long").collect()]
    assert lines[0].startswith("# spark") and "200,broken,failed: ValueError," in lines
    assert harness.speedups(runs, "seconds_brute", "seconds_index").where("ratio > 0").count() == 1
