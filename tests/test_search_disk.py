"""What searches leave on disk: one shuffle of all points for their places, none of pairs in a tile, and no files of ended steps."""

import time

from pyspark.sql import functions as F

from gridloom.operators import knn, places
from gridloom.plans import staging

from .test_copies import XY, asked, copies


def shuffle_files(spark):
    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {own.apply(i).getName() for i in range(own.size()) if own.apply(i).getName().startswith("shuffle_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_take_one_shuffle(spark):
    points = spark.createDataFrame([(7, 0.0, 1.0), (3, -0.0, 1.0), (5, 0.0, 1.0), (1, 2.0, 1.0), (9, None, 1.0)], "pid long, x1 double, x2 double")
    found = places.least_keys(points, XY, "pid", 2)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert sorted((r.n, sorted(r["keys"])) for r in found.collect()) == [(1, [1]), (2, [3, 5])]


def test_pairs_of_a_tile_are_not_shuffled(spark, monkeypatch):
    plans, own = [], knn.stage
    monkeypatch.setattr(knn, "stage", lambda df: plans.append((df.columns, plan(df))) or own(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = copies(spark, 60, 1)
        assert knn.knn(points, asked(spark, points, 300), 3, XY).count() == 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reach = [text for columns, text in plans if "__r" in columns]
    between = reach[0].partition("Window [")[2].partition("Join ")[0]
    assert len(reach) == 1 and between and "Exchange" not in between


def test_staged_steps_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
