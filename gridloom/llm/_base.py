"""What the operators of this subpackage share: the shared folder, written tables, text batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's switch that removes the shuffle files of a SQL execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows with texts that Spark and a worker hold at once: batches of the default 10,000 hold tens of MB in both, and a long text may
#: stand in all rows. It holds while a table is written.
TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets one
    of its own; on a cluster that would be a folder of one machine, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def _conf(spark: SparkSession, **pairs: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Table:
    """A DataFrame written to the shared folder: a cut in the lineage that survives lost executors."""

    #: Tables that are still there: results may read them until :func:`clean`.
    held: list[Table] = []

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy"):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Table.held.append(self)
        with _conf(spark, **{CLEANUP: "true"}):
            df.write.option("compression", compression).parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing unread depends on them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        Table.held.remove(self)


def clean() -> None:
    """Delete every table that the operators have written and not dropped; results not yet read are lost with them."""
    for table in list(Table.held):
        table.drop()


def write(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    return Table(df, name).df


def trim() -> None:
    """Give freed memory back to the system: workers stay for later tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """The same, of objects that refer to each other as well."""
    gc.collect()
    trim()


def trimmed(run):
    """``run`` over Arrow batches, trimmed when its last batch has gone and its own arrays with it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named text column of each holds about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), as (node, root): root is the least node reachable.

    Alternates large-star and small-star steps; each is an aggregate with map-side combine and a join, which
    adaptive execution splits for hot nodes. Only counts reach the driver. Isolated nodes do not appear.
    """

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least(df: DataFrame) -> Table:
        """Written, so that both sides of the joins below come straight from a shuffle and a hot node's edges are split."""
        return Table(df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")

    table = Table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = sign(table.df)
    for _ in range(most_rounds):
        if not was[0]:
            break
        e = table.df
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = least(both)
        large = both.join(low.df, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        stage = Table(large, "edges")
        down = stage.df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        under = least(down)
        small = down.join(under.df, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(under.df.select(F.col("u").alias("a"), F.col("m").alias("b")))
        following = Table(small.where("a <> b").distinct(), "edges")
        now = sign(following.df)
        for done in (table, stage, low, under):
            done.drop()
        table = following
        if now == was:
            return table.df.select(F.col("a").alias("node"), F.col("b").alias("root")).union(table.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        was = now
    if was[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return table.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
