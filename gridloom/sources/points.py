"""Point sets and query sets: synthetic, from files, from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import clip, drop_missing, rescale
from ..plans.config import axes


def uniform(spark: SparkSession, n: int, dims: int = 2, lo: float = 0.0, hi: float = 10000.0, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pid"), *((F.rand(seed + k) * (hi - lo) + lo).alias(c) for k, c in enumerate(axes(dims))))


def skewed(spark: SparkSession, n: int, dims: int = 2, lo: float = 0.0, hi: float = 10000.0, seed: int = 42, clusters: int = 20, share: float = 0.8) -> DataFrame:
    """A share of the points in normal clusters of very unequal weight, the rest uniform; all within the domain."""
    import numpy as np

    g = np.random.default_rng(seed)
    span = hi - lo
    weights = np.cumsum(g.dirichlet(np.full(clusters, 0.3)))
    centers = g.uniform(lo + 0.05 * span, hi - 0.05 * span, (clusters, dims))
    widths = g.uniform(0.005, 0.05, clusters) * span
    pick = F.size(F.filter(F.array(*(F.lit(float(w)) for w in weights[:-1])), lambda w: w <= F.col("__u")))
    value = lambda xs: F.get(F.array(*(F.lit(float(x)) for x in xs)), F.col("__c"))
    base = spark.range(n).select(F.col("id").alias("pid"), F.rand(seed).alias("__u"), (F.rand(seed + 1) < share).alias("__in")).withColumn("__c", pick)
    normal = [value(centers[:, k]) + F.randn(seed + 2 + k) * value(widths) for k in range(dims)]
    flat = [F.rand(seed + 50 + k) * span + lo for k in range(dims)]
    return base.select("pid", *(clip(F.when(F.col("__in"), a).otherwise(b), lo, hi).alias(c) for a, b, c in zip(normal, flat, axes(dims))))


def zipf(spark: SparkSession, n: int, dims: int = 2, hi: int = 10000, exponent: float = 1.001, seed: int = 42) -> DataFrame:
    """``n`` distinct integer points whose coordinates follow a power law, by inverting its continuous form: draws double until
    there are enough; fewer only where the domain has not as many points."""
    e = 1.0 - exponent
    draw = lambda k: F.floor(F.pow(1 + F.rand(seed + k) * (float(hi) ** e - 1), F.lit(1 / e))).cast("double")
    drawn, room = 2 * n, float(hi - 1) ** dims
    while True:
        many = spark.range(drawn).select(*(F.least(draw(k), F.lit(float(hi - 1))).alias(c) for k, c in enumerate(axes(dims)))).distinct()
        if many.limit(n).count() >= min(n, room) or drawn > 1000 * room:
            return many.limit(n).select(F.monotonically_increasing_id().alias("pid"), *axes(dims))
        drawn *= 2


def _with_ids(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("pid"), *(c.cast("double").alias(a) for c, a in zip(columns, axes(len(columns)))))


def read_csv(spark: SparkSession, path: str, columns: tuple[int, ...] = (0, 1), header: bool = True, sep: str = ",", quote: str = '"') -> DataFrame:
    """Numeric columns of a delimited file by position; ``header``: the first row of each file is no point. A value that is no
    number is null: :func:`malformed` counts such rows, ``drop_missing`` drops them."""
    raw = spark.read.option("header", header).option("enforceSchema", True).option("sep", sep).option("quote", quote)
    raw = raw.schema(", ".join(f"_c{k} string" for k in range(max(columns) + 1))).csv(path)
    return _with_ids(raw, [F.expr(f"try_cast(trim(`_c{c}`) as double)") for c in columns])


def malformed(points: DataFrame) -> DataFrame:
    """One row: how many points there are and how many lack a coordinate."""
    lacks = " or ".join(f"{c} is null or isnan({c})" for c in points.columns if c != "pid")
    return points.agg(F.count("*").alias("n"), F.count_if(F.expr(lacks)).alias("n_malformed"))


def read_npy(spark: SparkSession, path: str, dims: int = 2) -> DataFrame:
    """The first columns of a two-dimensional array file, which the driver reads: for files that fit there."""
    import numpy as np

    data = np.load(path)
    if data.ndim != 2 or data.shape[1] < dims:
        raise ValueError(f"{path} is not an array of {dims} columns or more")
    return _with_ids(spark.createDataFrame([tuple(map(float, r)) for r in data[:, :dims]], [f"v{k}" for k in range(dims)]), [F.col(f"v{k}") for k in range(dims)])


def cities(spark: SparkSession, path: str) -> DataFrame:
    """A world cities file: columns 2 and 3, quoted or not."""
    return drop_missing(read_csv(spark, path, (2, 3)), ["x1", "x2"])


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer file, tab-separated: columns 4 and 5; rows without numbers go."""
    return drop_missing(read_csv(spark, path, (4, 5), header=False, sep="\t", quote=""), ["x1", "x2"])


def pixels(spark: SparkSession, path: str, grid: int = 8) -> DataFrame:
    """Six-dimensional points from binary PPM images: colours of grid pixels and of their mirror images, distinct.

    Each is moved by a uniform variate in [0, 1) and scaled by 1000 / 257, plus 0.001. Files are read by Spark, one at a time.
    """
    import re
    from collections.abc import Iterator

    import pandas as pd

    def colours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for data in batch["content"]:
                m = re.match(rb"P6\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
                if not m:
                    continue
                w, h = int(m[1]), int(m[2])
                at = lambda x, y: tuple(data[m.end() + 3 * (y * w + x) :][:3])  # noqa: B023, E731
                rows |= {(*at(x, y), *at(w - 1 - x, y)) for x in range(0, (w + 1) // 2, max(1, w // grid)) for y in range(0, h, max(1, h // grid))}
            yield pd.DataFrame(sorted(rows), columns=[f"v{k}" for k in range(6)])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    own = found.mapInPandas(colours, ", ".join(f"v{k} int" for k in range(6))).distinct()
    return _with_ids(own, [(F.col(f"v{k}") + F.rand(k)) / 257 * 1000 + 0.001 for k in range(6)])


def from_table(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of a table as a point set."""
    return table.select(F.col(key).alias("pid"), *(F.col(c).cast("double").alias(a) for c, a in zip(columns, axes(len(columns)))))


def load_points(spark: SparkSession, spec: str, n: int = 100_000, lo: float = 0.0, hi: float = 10000.0, dims: int = 2, seed: int = 42) -> DataFrame:
    """A point set by name: uniform, skewed, zipf, csv:PATH, npy:PATH, cities:PATH, geonames:PATH, pixels:PATH; files are rescaled,
    all but the pixels, which have a scale of their own."""
    kind, _, path = spec.partition(":")
    if spec in ("uniform", "skewed"):
        return {"uniform": uniform, "skewed": skewed}[spec](spark, n, dims, lo, hi, seed)
    if spec == "zipf":
        return zipf(spark, n, dims, int(hi), seed=seed)
    if kind == "pixels" and path:
        return pixels(spark, path)
    readers = {"csv": read_csv, "npy": read_npy, "cities": cities, "geonames": geonames}
    if kind not in readers or not path:
        raise ValueError(f"unknown point source {spec!r}")
    return rescale(readers[kind](spark, path), ["x1", "x2"], lo, hi)


def random_boxes(spark: SparkSession, n: int, dims: int = 2, lo: float = 0.0, hi: float = 10000.0, half_share: float = 0.005, seed: int = 1) -> DataFrame:
    """(qid, lo1.., hi1..): centres inset by the half-width, half-widths between 0.5 and 1.5 of it."""
    half = half_share * (hi - lo)
    own = spark.range(n).withColumnRenamed("id", "qid")
    for k in range(1, dims + 1):
        own = own.withColumn(f"__c{k}", F.rand(seed + k) * (hi - lo - 2 * half) + lo + half).withColumn(f"__h{k}", (F.rand(seed + 20 + k) + 0.5) * half)
    return own.select("qid", *((F.col(f"__c{k}") - F.col(f"__h{k}")).alias(f"lo{k}") for k in range(1, dims + 1)), *((F.col(f"__c{k}") + F.col(f"__h{k}")).alias(f"hi{k}") for k in range(1, dims + 1)))


def corner_boxes(spark: SparkSession, n: int, dims: int = 2, lo: float = 0.0, hi: float = 10000.0, most: float = 5000.0, seed: int = 1) -> DataFrame:
    """(qid, lo1.., hi1..): a uniform lower corner and sides up to ``most``, clipped to the domain."""
    own = spark.range(n).select(F.col("id").alias("qid"), *((F.rand(seed + k) * (hi - lo) + lo).alias(f"lo{k}") for k in range(1, dims + 1)))
    return own.withColumns({f"hi{k}": F.least(F.col(f"lo{k}") + F.rand(seed + 20 + k) * most, F.lit(hi)) for k in range(1, dims + 1)})


def random_keys(spark: SparkSession, n: int, last: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("qid"), (F.rand(seed) * 0.99 * last).alias("key"))
