"""Written intermediates: cuts in the lineage that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's switch that removes the shuffle files of a SQL execution when it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders that :func:`stage` has written and :func:`clean` has not deleted.
_staged: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names. Where that is unset, a local session (tests) gets a folder of its
    own; on a cluster that would be a folder of one machine, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. Its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = folder(spark, "stage")
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Delete what was staged; results not yet read are lost with it."""
    while _staged:
        spark, path = _staged.pop()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
