"""Near-duplicates by exact Jaccard similarity: the near-dedup stage of the pipeline.

Two texts are copies if the sets of their ``WIDTH``-word shingles have a Jaccard similarity of ``SIMILAR`` or more. Candidates are
the components of ``simhash.near_duplicates``, over all rows. No radius of 64-bit fingerprints that can be searched holds all
such pairs (at 0.8 they differ in 10 bits and more), so more candidates come from ``BANDS`` bands of ``ROWS`` minima of the shingle
hashes: a pair at 0.8 shares a band with probability 0.998. Every candidate, of either kind, is verified by the shingle sets of
both whole texts. Texts with equal sets are one node from the start.

Inside a band or a component of fingerprints, members meet the least one first. In a band, those that are then in different groups
meet each other too, so a large group of copies costs as many pairs as it has members. In a component, which chains link, they do
not: that would be the square of its size. Bands of more than ``PAIRED`` members are not spelled out as pairs of texts: their members
are dealt into blocks, and a task compares two blocks, each text read once, and reports a forest of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._base import TEXTS, _conf, components, slices, trimmed, write
from .simhash import _forest, shingle_hashes

WIDTH = 5
SIMILAR = 0.8
BANDS = 20
#: Minima in a band: 1 - (1 - 0.8 ** 6) ** 20 = 0.998.
ROWS = 6
CHUNK_BYTES = 4 << 20
#: Members of a band that meet as pairs of texts; those of larger ones meet in blocks of about so many members and shingles.
PAIRED, MEMBERS, SHINGLES = 32, 512, 1 << 20
#: Shingles whose hashes are mixed at once.
BLOCK = 2048
_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text without words has none."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; an empty set has no band."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), BLOCK):
        mixed = (hashes[None, i : i + BLOCK] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        # fold the well mixed upper half into the lower one, and mix again: products alone order alike
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", CHUNK_BYTES):
        keys, bands, sizes = [], [], []
        for text in part.column("text").to_pylist():
            own = shingle_set(text)
            keys.append(xxhash.xxh3_128_digest(own.tobytes()))
            bands.append(np.array(band_keys(own), np.uint64).view(np.int64))
            sizes.append(len(own))
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["row", "same", "bands", "size"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, of = None, np.zeros(0, np.uint64)
    for batch in batches:
        at = []
        ids, texts, others = batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b")
        for i, a in enumerate(ids):
            if a != last:
                last, of = a, shingle_set(texts[i].as_py())
            if jaccard(of, shingle_set(others[i].as_py())) >= SIMILAR:
                at.append(i)
        yield batch.select(["a", "b"]).take(pa.array(at, pa.int64()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    with _conf(pairs.sparkSession, **TEXTS):
        return write(both.mapInArrow(trimmed(_verify), "a long, b long"), "alike")


def _links(sets: list[np.ndarray], nodes: np.ndarray, roots: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the similar pairs of different roots, of two blocks or inside one; no set is empty."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark, inside = np.zeros(len(distinct), np.int32), (blocks == blocks[0]).all()
    a, b = [], []
    for x in range(len(sets) - 1):
        others = x + 1 + np.flatnonzero((roots[x + 1 :] != roots[x]) & (inside | (blocks[x + 1 :] != blocks[x])))
        if len(others):
            own = at[starts[x] : ends[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[at], starts)[others]
            mark[own] = 0
            near = others[both / (sizes[x] + sizes[others] - both) >= SIMILAR]
            a.append(np.full(len(near), nodes[x]))
            b.append(nodes[near])
    return _forest(np.concatenate(a), np.concatenate(b)) if sum(map(len, a)) else (nodes[:0], nodes[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell (band, i, j), whose rows follow one another; sets are held, texts are not."""
    cell, held = None, []

    def close() -> pa.RecordBatch:
        a, b = _links([x[0] for x in held], *(np.array(x, np.int64) for x in list(zip(*held))[1:]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        texts = batch.column("text")
        for i, (band, x, y, *rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "node", "root", "block")))):
            if (band, x, y) != cell and held:
                yield close()
                held.clear()
            cell = (band, x, y)
            held.append((shingle_set(texts[i].as_py()), *rest))
    if held:
        yield close()


def _crowded(members: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) with the components of all similar pairs of different roots in one band, from members (band, node, root)."""
    sized = write(members.join(sets.select("node", "size"), "node"), "crowd")
    parts = sized.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("parts"))
    dealt = sized.join(parts, "band").withColumn("block", F.pmod(F.xxhash64("node", "band"), "parts").cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = each.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block")
    read = cells.join(texts.select(F.col("row").alias("node"), "text"), "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    with _conf(members.sparkSession, **TEXTS):
        return write(read.mapInArrow(trimmed(_compare), "a long, b long"), "crowded")


def by_minima(sets: DataFrame) -> DataFrame:
    """(node, band): candidates by bands of minima."""
    return sets.select("node", F.explode("bands").alias("band"))


def by_fingerprint(rows: DataFrame, described: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, band): candidates by components of linked fingerprints; a node is in those of all its rows."""
    found = simhash.near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    each = described.select("row", "same").join(found, "row").select("same", "component_id").distinct()
    return write(each.join(sets.select("same", "node"), "same").select("node", F.xxhash64(F.lit("simhash"), "component_id").alias("band")).distinct(), "linked")


def groups(rows: DataFrame) -> DataFrame:
    """(row, root) for ``rows`` (row, text): root is the least row that copies lead to; ``row`` is a unique long.

    ``rows`` must give the same rows whenever it is read. Null and empty texts are copies of each other. A text of fewer than
    ``WIDTH`` words is one shingle. An empty table gives an empty one.
    """
    plain = rows.select("row", "text")
    with _conf(rows.sparkSession, **TEXTS):
        described = write(plain.mapInArrow(trimmed(_describe), "row long, same binary, bands array<long>, size long"), "described")
    # one row for equal sets; all of them have the same bands
    sets = write(described.groupBy("same").agg(F.min("row").alias("node"), F.first("bands").alias("bands"), F.first("size").alias("size")), "sets")
    banded = by_minima(sets).withColumn("every", F.lit(True)).union(by_fingerprint(plain, described, sets).withColumn("every", F.lit(False)))
    leads = write(banded.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "leads")
    met = write(banded.join(leads, "band"), "met")
    star = write(met.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = star.select(F.col("a").alias("row")).union(star.select(F.col("b").alias("row"))).distinct()
    texts = write(plain.join(wanted.hint("shuffle_hash"), "row", "left_semi"), "texts")
    edges = _verified(star, texts)
    roots = write(components(edges), "roots")
    tagged = write(met.where("every").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "tagged")
    split = write(tagged.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select("band", "n"), "split")
    mixed = write(tagged.join(split, "band"), "mixed")
    few = mixed.where(F.col("n") <= PAIRED).drop("n")
    one, two = few.toDF("band", "a", "ra"), few.toDF("band", "b", "rb")
    rest = one.join(two, "band").where("a < b and ra <> rb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    edges = edges.union(_verified(write(rest, "rest"), texts)).union(_crowded(mixed.where(F.col("n") > PAIRED).drop("n"), sets, texts))
    roots = write(components(edges), "roots")
    named = sets.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return described.select("row", "same").join(write(named, "named"), "same").select("row", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of copies: that with the least ``doc_id``, null last.

    Rows get a key of their own, written before it is used, so null and repeated ids count as any other.
    """
    keyed = write(docs.withColumn("row", F.monotonically_increasing_id()), "keyed")
    ids = groups(keyed).join(keyed.select("row", "doc_id"), "row")
    first = ids.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first"))
    kept = write(first.select("first.row"), "kept")
    return keyed.join(kept.hint("shuffle_hash"), "row", "left_semi").select(docs.columns)
