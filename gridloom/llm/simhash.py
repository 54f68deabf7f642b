"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * half`` bits share a variant within ``half`` bits of each. So every distinct
fingerprint emits all its variants within ``half`` bits, the variants meet in a shuffle, and fingerprints that share one are
linked: by the triangle inequality any two of them differ in at most ``2 * half`` bits, so a link from the least member to
each other member of a meeting keeps the components whole without emitting all pairs. Every link is verified.

Variants travel as packed arrays, one row for a block of fingerprints and a bucket, in ``PASSES`` passes over the variant
space: a fixed number, so that what lies on disk at once is a fixed share of all variants at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import TEXTS, Table, _conf, components, slices, trimmed, write

SEED = 42
#: Passes over the variant space.
PASSES = 8
#: Fingerprints in a block, whose variants of one pass are in memory at once: an eighth of 2,081 each at ``half`` 2.
BLOCK = 2048
#: Fingerprints of a block whose variants of all passes are.
SPREAD = 256
#: Variants that one bucket of a pass should hold.
BUCKET = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Text whose shingles are hashed at once: 64 bytes for the bits of each. A longer text goes in blocks of shingles.
CHUNK_BYTES = 1 << 19
SHINGLES = 1 << 16


def _masks(half: int) -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array([sum(c) for n in range(half + 1) for c in combinations(one, n)], dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each shingle of the words of ``text``; fewer words than ``width``: of the whole sequence; none: empty."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])] or [digest(joined, SEED)]


def _spans(joined: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the shingles of blank-joined words begin and end."""
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    return (starts[: len(ends) - width + 1], ends[width - 1 :]) if len(ends) >= width else (starts[:1], ends[-1:])


def long_fingerprint(text: str, width: int) -> np.uint64:
    """The fingerprint of a text of any length, its shingles taken in blocks: the memory is a few times the text."""
    joined = b" ".join(text.encode().lower().split())
    if not joined:
        return np.uint64(0)
    starts, ends = _spans(joined, width)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), SHINGLES):
        own = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + SHINGLES].tolist(), ends[k : k + SHINGLES].tolist())], np.uint64)
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0]


def _majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: bits set in over half of a run; an empty run: zero."""
    n = np.array(counts, np.int64)
    ones = np.zeros((len(n), 64), np.int64)
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = np.cumsum(n)
    for k in np.flatnonzero(n).tolist():  # run by run: reduceat to a wider type copies all bits as that type
        ones[k] = bits[ends[k] - n[k] : ends[k]].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint of each whole text; a text without words, empty or null, has fingerprint 0."""
    w = width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            hashes, counts = [], []
            if part.num_rows == 1 and len(text := part.column("text")[0].as_py() or "") > CHUNK_BYTES:
                print_ = np.array([long_fingerprint(text, w)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(print_)], names=["doc_id", "fp"])
                continue
            for text in part.column("text").to_pylist():
                own = shingle_hashes(text, w)
                hashes += own
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_majority(hashes, counts).view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), f"doc_id {dict(plain.dtypes)['doc_id']}, fp long")


def _emit(half: int, passes: int, turn: int, buckets: int):
    """Variants of blocks of fingerprints whose mixed value falls in this pass, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(half)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), BLOCK):
                found = []
                for few in np.split(block := fps[i : i + BLOCK], range(SPREAD, len(block), SPREAD)):
                    variants = (few[:, None] ^ masks[None, :]).reshape(-1)
                    mixed = ((variants * MIX) >> np.uint64(32)) * np.uint64(passes)
                    own = np.flatnonzero(mixed >> np.uint64(32) == turn)
                    rest = mixed[own] & np.uint64(0xFFFFFFFF)
                    found.append((((rest * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32), variants[own], (own % len(masks)).astype(np.uint16)))
                bucket, what, mask = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(bucket, kind="stable")
                bucket, what, mask = bucket[order], what[order], mask[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cuts[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array([what[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([mask[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
                    names=["bucket", "variants", "masks"],
                )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to roots with the components of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _meet(half: int):
    """Links between fingerprints that share a variant: those of a task shrink to a forest, bucket by bucket."""

    def links(variants: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = max(16, int(len(variants)).bit_length() + 2)
        slot = ((variants * MIX) >> np.uint64(64 - bits)).astype(np.int64)
        twice = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
        v, o = variants[twice], origin[twice]
        order = np.lexsort((o, v))
        v, o = v[order], o[order]
        first = np.flatnonzero(np.diff(v, prepend=v[:1] ^ np.uint64(1))) if len(v) else np.zeros(0, np.int64)
        lead = np.repeat(o[first], np.diff(np.append(first, len(v))))
        other = np.flatnonzero(lead != o)
        return lead[other], o[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(half)
        a = b = np.zeros(0, np.uint64)
        bucket, held = None, []

        def close():
            nonlocal a, b
            variants = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in held])
            x, y = links(variants, variants ^ masks[np.concatenate([np.frombuffer(m, np.uint16) for _, m in held])])
            near = np.bitwise_count(x ^ y) <= 2 * half
            if near.any():
                a, b = _forest(np.concatenate((a, x[near])), np.concatenate((b, y[near])))

        for batch in batches:
            for k, v, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if k != bucket and held:
                    close()
                    held = []
                bucket = k
                held.append((v.as_buffer(), m.as_buffer()))
        if held:
            close()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(distinct: DataFrame, half: int = 2, passes: int = PASSES) -> DataFrame:
    """Edges (a, b) over distinct fingerprints with the components of all pairs at ``2 * half`` or fewer differing bits.

    A root that a task reports may lie further from its members than that: tasks report forests, not pairs.
    """
    spark = distinct.sparkSession
    table = Table(distinct.select("fp"), "fps")
    total = table.df.count() * len(_masks(half))
    buckets = max(1, total // passes // BUCKET)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = table.df.repartition(parts)  # few bytes, much work: the files alone would make too few tasks
    found = None
    for turn in range(passes):
        sent = even.mapInArrow(trimmed(_emit(half, passes, turn, buckets)), "bucket int, variants binary, masks binary")
        met = sent.repartition(min(buckets, parts), "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_meet(half)), "a long, b long")
        part = write(met, "links")
        found = part if found is None else found.union(part)
    table.drop()
    return found


def near_duplicates(docs: DataFrame, width: int = 4, half: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at ``2 * half`` or fewer differing bits; component_id is the least id reachable.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles count as often as they occur. Null and empty
    texts have fingerprint 0, linked like any other. Every input row gives one row; repeated rows repeat. A null id never
    names a component unless all its ids are null. Other columns of ``docs`` are ignored. An empty table gives an empty one.
    """
    with _conf(docs.sparkSession, **TEXTS):
        prints = write(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = write(components(links(distinct, half)), "roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the join below splits a hot component
    least = write(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`near_duplicates`."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least id, null ids last; rows get a key of their own, so repeated and
    null ids count as any other."""
    keyed = write(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("root"))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "__row")
    kept = write(found.join(keyed.select("__row", "doc_id"), "__row").groupBy("root").agg(F.min(order).alias("first")).select("first.__row"), "kept")
    return keyed.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(docs.columns)
