"""Searches over tables in which no two points share a place."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import knn, ranges

from .test_copies import XY
from .test_search_disk import plan


def scattered(spark, n, wide=1000.0):
    """Points that lie ever thinner along the first dimension."""
    return spark.range(n).select(F.col("id").alias("pid"), (wide * F.pow(F.rand(1), 4)).alias("x1"), (wide * F.rand(2)).alias("x2"))


def around(points):
    """Every fifth point as a query, a few of them far from all points."""
    far = F.when(F.col("pid") % 50 == 0, 1900.0).otherwise(0.0)
    return points.where("pid % 5 = 0").select(F.col("pid").alias("qid"), (F.col("x1") + far).alias("c1"), F.col("x2").alias("c2"))


def executions(spark, run):
    """The result of ``run`` and how many SQL executions it took."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before, out = store.executionsCount(), run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, store.executionsCount() - before


@pytest.mark.parametrize("top", [None, 30.0])
def test_box_variant_takes_one_box_a_query(spark, top):
    points = scattered(spark, 1500).localCheckpoint()
    queries = around(points)
    got, runs = executions(spark, lambda: {(r.qid, r["rank"]): r.dist for r in knn.knn_box(points, queries, 6, XY, 2.0, rounds=10, top=top).collect()})
    rows, halves, answered = [(r.x1, r.x2) for r in points.collect()], [2.0 * 2**i if top is None else min(2.0 * 2**i, top) for i in range(10)], set()
    for q in queries.collect():
        for h in halves:
            held = sorted(math.sqrt((x - q.c1) * (x - q.c1) + (y - q.c2) * (y - q.c2)) for x, y in rows if abs(x - q.c1) <= h and abs(y - q.c2) <= h)
            if len(held) >= 6:
                answered.add(h)
                break
        assert [got[q.qid, n + 1] for n in range(6)] == (held[:6] if len(held) >= 6 else [None] * 6)
    assert len(got) == 300 * 6 and len(answered) >= 3
    assert runs <= 16


def test_predicted_radii_too_wide_meet_few(spark):
    from gridloom.operators import lattice

    from .test_copies import most_rows

    points = scattered(spark, 1500).localCheckpoint()
    fitted = lattice.nodes(spark, 4, 2, 0.0, 1000.0).select("node_id", F.lit(900.0).alias("b"))
    got, most = most_rows(spark, lambda: sorted(map(tuple, lattice.knn_by_radius(points, around(points), 6, XY, fitted, 4, 0.0, 1000.0).collect())))
    assert got == sorted(map(tuple, knn.brute(points, around(points), 6, XY).collect()))
    assert most < 100_000


def test_brute_counts_skip_blocks_out_of_reach(spark):
    points = scattered(spark, 6000).localCheckpoint()
    half = F.when(F.col("pid") % 100 == 0, 700.0).when(F.col("pid") % 777 == 0, None).otherwise(3.0)
    boxes = points.where("pid % 2 = 0").select(F.col("pid").alias("qid"), *(e.alias(f"{s}{k}") for k in (1, 2) for s, e in (("lo", F.col(f"x{k}") - half), ("hi", F.col(f"x{k}") + half))))
    counts = ranges.brute_counts(points, boxes, XY)
    assert "NestedLoopJoin" not in plan(counts)
    got = {r.qid: r.n for r in counts.collect()}
    assert got == {r.qid: r.n for r in ranges.range_counts(points, boxes, XY).collect()} and len(got) == 3000


def test_brute_passes_on_what_lies_within_reach(spark):
    from .test_copies import most_rows

    points = scattered(spark, 20_000).localCheckpoint()
    queries = around(points).where("qid % 10 = 0")
    got, most = most_rows(spark, lambda: sorted(map(tuple, knn.brute(points, queries, 6, XY).collect())), "MapInArrow")
    assert got == sorted(map(tuple, knn.knn(points, queries, 6, XY).collect())) and len(got) == 12_000
    assert most < 40_000
