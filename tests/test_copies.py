"""Searches over tables with many rows at one place, and how many rows their plans make for them."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import knn, lattice, ranges
from gridloom.plans import catalog

XY = ["x1", "x2"]


def most_rows(spark, run, node=""):
    """The result of ``run`` and the most rows that a node of its plans, of that name, has made."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        number = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                m = metrics.apply(j)
                found = values.get(m.accumulatorId())
                if node in nodes.apply(i).name() and m.name() == "number of output rows" and found.isDefined():
                    most = max(most, int(found.get().replace(",", "")))
    return out, most


def copies(spark, side, times):
    """A square of places, each held by ``times`` points; neighbours lie 10 apart."""
    ids = spark.range(side * side * times).withColumnRenamed("id", "pid")
    return ids.select("pid", *((F.floor(F.col("pid") % (side * side) / d) % side * 10.0).cast("double").alias(c) for c, d in (("x1", 1), ("x2", side))))


def asked(spark, points, n):
    return points.where(F.col("pid") < n).select(F.col("pid").alias("qid"), F.col("x1").alias("c1"), (F.col("x2") + 1.0).alias("c2"))


def brute(points, queries, k):
    rows = [(r.pid, r.x1, r.x2) for r in points.collect()]
    found = {}
    for q in queries.collect():
        near = {p: d for p, x, y in rows if (d := math.sqrt((x - q.c1) * (x - q.c1) + (y - q.c2) * (y - q.c2))) < 40}
        found |= {(q.qid, n + 1): (p, near[p]) for n, p in enumerate(sorted(near, key=lambda p: (near[p], p))[:k])}
    return found


def test_kth_radius_meets_places_once(spark):
    points = copies(spark, 20, 30)
    got, most = most_rows(spark, lambda: knn.kth_radius(points, points.where("pid % 6 = 0"), 5, XY).collect())
    assert len(got) == 2000 and all(r.radius == 0 for r in got)
    assert most < 50_000


@pytest.mark.parametrize("k", [4, 40])
def test_knn_meets_places_once(spark, k):
    points = copies(spark, 20, 30)
    queries = asked(spark, points, 1200)
    got, most = most_rows(spark, lambda: {(r.qid, r["rank"]): (r.pid, r.dist) for r in knn.knn(points, queries, k, XY).collect()})
    assert len(got) == 1200 * k
    assert {q: v for q, v in got.items() if q[0] < 60} == brute(points, queries.where("qid < 60"), k)
    assert most < 130_000


def test_knn_of_distinct_points_meets_few(spark):
    points = copies(spark, 150, 1)
    got, most = most_rows(spark, lambda: knn.knn(points, asked(spark, points, 3000), 3, XY).count())
    assert got == 9000 and most < 600_000


def test_knn_of_few_places_and_missing_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, -0.0, 0.0), (5, 9.0, 0.0)], "pid long, x1 double, x2 double")
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 1e9, -1e9)], "qid long, c1 double, c2 double")
    got = sorted((r.qid, r["rank"], r.pid) for r in knn.knn(points, queries, 9, XY).collect())
    assert got == [(1, 1, 1), (1, 2, 4), (1, 3, 5), (3, 1, 5), (3, 2, 1), (3, 3, 4)]
    assert knn.knn(points.limit(0), queries, 2, XY).count() == 0


@pytest.mark.parametrize("start", [2.0, 9.5, 10.0])
def test_box_variant_meets_places_once(spark, start):
    points = copies(spark, 20, 30)
    queries = asked(spark, points, 1200)
    got, most = most_rows(spark, lambda: {(r.qid, r["rank"]): r.dist for r in knn.knn_box(points, queries, 40, XY, start, rounds=4).collect()})
    rows, want = [(r.pid, r.x1, r.x2) for r in points.collect()], {}
    for q in queries.where("qid in (0, 7, 21, 399, 405)").collect():
        for r in (start, start * 2, start * 4, start * 8):
            held = sorted((math.sqrt((x - q.c1) * (x - q.c1) + (y - q.c2) * (y - q.c2)), p) for p, x, y in rows if abs(x - q.c1) <= r and abs(y - q.c2) <= r)
            if len(held) >= 40:
                break
        want |= {(q.qid, n + 1): held[n][0] if len(held) >= 40 else None for n in range(40)}
    assert len(got) == 1200 * 40 and {x: got[x] for x in want} == want
    assert most < 130_000


def test_predicted_radii_meet_places_once(spark):
    points = copies(spark, 20, 30)
    queries = asked(spark, points, 1200)
    fitted = lattice.nodes(spark, 4, 2, 0.0, 190.0).select("node_id", F.when(F.col("c1") < 100, 35.0).otherwise(1.0).alias("b"))
    got, most = most_rows(spark, lambda: {(r.qid, r["rank"]): (r.pid, r.dist) for r in lattice.knn_by_radius(points, queries, 40, XY, fitted, 4, 0.0, 190.0).collect()})
    assert len(got) == 1200 * 40 and {q: v for q, v in got.items() if q[0] < 60} == brute(points, queries.where("qid < 60"), 40)
    assert most < 130_000


def test_brute_counts_meet_places_once(spark):
    points = copies(spark, 20, 30)
    boxes = points.where("pid < 1200").select(F.col("pid").alias("qid"), *(e.alias(f"{s}{k}") for k in (1, 2) for s, e in (("lo", F.col(f"x{k}") - 10), ("hi", F.col(f"x{k}") + 10))))
    boxes = boxes.withColumn("hi1", F.when(F.col("qid") == 5, None).when(F.col("qid") == 6, -99.0).otherwise(F.col("hi1")))
    got, most = most_rows(spark, lambda: {r.qid: r.n for r in ranges.brute_counts(points, boxes, XY).collect()})
    side = lambda v: 2 if v in (0, 19) else 3
    assert got == {q: 0 if q in (5, 6) else 30 * side(q % 20) * side(q // 20 % 20) for q in range(1200)}
    assert most <= 12_000


def test_spheres_meet_places_once(spark, monkeypatch):
    from gridloom.operators import places

    points = copies(spark, 20, 30).withColumn("name", F.lit("a"))
    spheres = asked(spark, points, 1200).withColumn("r", F.when(F.col("qid") == 3, None).otherwise(10.0))
    for chunk in (places.CHUNK, 7):
        monkeypatch.setattr(places, "CHUNK", chunk)
        got, most = most_rows(spark, lambda: [tuple(r) for r in ranges.sphere_rows(points, spheres, XY, digits=2).select("qid", "pid", "x1", "x2", "name", "dist").collect()], "Join")
        want = {(q, p): (p % 20 * 10.0, p // 20 % 20 * 10.0) for q in range(1200) for p in range(12_000) if q != 3 and p % 20 == q % 20 and p // 20 % 20 - q // 20 % 20 in (0, 1)}
        assert len(got) == len(want) and {(q, p): (x, y) for q, p, x, y, _, _ in got} == want
        assert all(n == "a" and d in (1.0, 9.0) for *_, n, d in got)
        assert most < 12_000
    assert {r.qid: r.n for r in ranges.sphere_counts(points, spheres, XY).collect()} == {q: 0 if q == 3 else 60 if q // 20 % 20 < 19 else 30 for q in range(1200)}
    assert ranges.sphere_rows(points.select(*XY), spheres.where("qid = 0"), XY).count() == 60


def test_brute_neighbours_meet_places_once(spark):
    points = copies(spark, 20, 30)
    queries = asked(spark, points, 1200)
    got, most = most_rows(spark, lambda: {(r.qid, r["rank"]): (r.pid, r.dist) for r in knn.brute(points, queries, 40, XY).collect()})
    assert len(got) == 1200 * 40 and {q: v for q, v in got.items() if q[0] < 60} == brute(points, queries.where("qid < 60"), 40)
    assert most < 200_000
    assert knn.brute(points, queries.where("qid = 1"), 20_000, XY).count() == 12_000 and knn.brute(points.limit(0), queries, 3, XY).count() == 0


def test_within_looks_for_k_only(spark):
    points = copies(spark, 20, 30)
    spheres = asked(spark, points, 1200).withColumn("r", F.when(F.col("qid") < 600, 25.0).otherwise(0.9))
    got, most = most_rows(spark, lambda: [(r.qid, r["rank"], r.dist) for r in knn.within(points, spheres, 5, XY).collect()])
    assert sorted(got) == [(q, n, 1.0) for q in range(600) for n in range(1, 6)] + [(q, n, None) for q in range(600, 1200) for n in range(1, 6)]
    assert most < 20_000


def test_recall_meets_places_once(spark, tmp_path):
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        own = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        own.crossJoin(spark.range(40)).withColumn(key, F.col(key) + F.col("id") * 100_000).drop("id").write.parquet(f"{tmp_path}/{name}.parquet")
    got, most = most_rows(spark, lambda: catalog.queries()["recall_at_k"](spark, str(tmp_path)).collect())
    assert len(got) == 1 and got[0].recall > 0.9
    assert most < 100_000


def test_corners_meet_their_strip_only(spark):
    points = copies(spark, 40, 8).withColumn("x1", F.when(F.col("pid") % 3 == 0, 100.0).otherwise(F.col("x1")))
    corners = points.where("pid < 1600").select(F.col("pid").alias("qid"), F.col("x1").alias("hi1"), (F.col("x2") + 5).alias("hi2"))
    corners = corners.unionByName(spark.createDataFrame([(9001, -1.0, 1e9), (9002, 1e9, 1e9), (9003, None, 1.0), (9004, 105.0, 25.0)], corners.schema))
    got, most = most_rows(spark, lambda: {r.qid: r.n for r in ranges.dominated_counts(points, corners, XY).collect()})
    rows = [(r.x1, r.x2) for r in points.collect()]
    some = [(r.qid, r.hi1, r.hi2) for r in corners.where("qid % 37 = 0 or qid > 9000").collect()]
    assert len(got) == 1604 and {q: got[q] for q, _, _ in some} == {q: sum(x <= a and y <= b for x, y in rows) if a is not None else 0 for q, a, b in some}
    assert most < 200_000
