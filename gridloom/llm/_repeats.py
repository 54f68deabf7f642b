"""Repeated windows over all documents, for the two substring operators.

A window is ``width`` consecutive items (words or bytes) of one document: a suffix cut at that length. Sorting all suffixes of a
corpus is out of reach, so windows are looked at where their anchors repeat. Each window picks an anchor: the item position in it
whose ``gram``-item hash is least, leftmost on ties, so equal windows pick the same anchor. The windows of one anchor are
consecutive; together they span a segment, and every window lies in exactly one segment.

1. Rows are told apart by their ids where these are unique, else by a key of their own that is written once with the text.
2. Anchors are counted by gram. They travel packed, one row for a chunk of text and a bucket of grams, so that a frequent gram
   is one entry of a chunk; grams that cannot repeat go. Anchors meet the grams that are left in buckets dealt ``SALTS`` times.
3. Equal segments become one row with their count and least document before anything else looks at them. The suffixes of a gram
   with one segment differ from each other, so each is a leaf of its own, counted as often as the segment.
4. Suffixes are split by prefixes of variable length. A window holds its gram and, of what is left, at least half on one side:
   the windows of a segment with more on the left are keyed by that half and the gram, the others by the gram and the half after
   it. What shares such a prefix forms a group; prefixes of more than ``HOT`` segments are lengthened to all ``width`` items.
   Over every group stands the operator's own structure (suffix tree, suffix array), and what it finds is what repeats. A group
   split by all its items is a single node of that depth: its leaves are only counted.
5. What is found goes back to every place of a segment, and from there to the rows.

Documents with null ids count as the largest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import Table, slices

#: Segments of a prefix that are compared in one group, at most; longer prefixes split the others.
HOT = 5000
CHUNK_BYTES = 2 << 20
#: Bytes of segments that are compared at once; a group stays whole.
GROUP_BYTES = 2 << 20
#: Anchors that a bucket of grams should hold; each bucket is dealt to ``SALTS`` tasks where anchors meet grams.
BUCKET, SALTS = 1 << 20, 8
#: Anchors that are packed together, and buckets for each partition, so that partitions are even.
CHUNK, FEWEST = 1 << 19, 8
#: Rows that a task gives back at once.
OUT_ROWS = 1 << 16
BASE, LAST = 0x9E3779B97F4A7C15, (1 << 63) - 1
PLACE = np.uint64((1 << 24) - 1)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LOW32 = (1 << 32) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            grow = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))), dtype=np.uint64)
            cls.up, cls.down = grow(np.uint64(BASE)), grow(np.uint64(pow(BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def anchors(items: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, segment hash, document number, first window, and items before the gram in it << 8 | windows, of each anchor.

    ``items`` are the hashed items of documents one after the other (fewer than 2^24), ``ends`` where each document ends.
    """
    n, span = len(items), width - gram + 1
    starts = np.concatenate(([0], ends[:-1]))
    none = np.zeros(0, np.int64)
    if n < width:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    up, down = Powers.get(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(items * up[:n], dtype=np.uint64)))
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    held = 1
    while 2 * held <= span:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    if held < span:
        least = np.minimum(least[: held - span], least[span - held :])
    place = (least & PLACE).astype(np.int32)
    # windows that cross into the next document belong to none
    crossing = np.zeros(len(place), bool)
    inner = ends[:-1]
    if len(inner):
        at = (inner[:, None] - np.arange(1, width)[None, :]).ravel()
        crossing[at[(at >= 0) & (at < len(place))]] = True
    real = np.flatnonzero(~crossing)
    if not len(real):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    at = place[real]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    first, count = real[cut], np.diff(np.append(cut, len(real)))
    anchor = at[cut]
    stop = first + count + width - 1
    whole = (sums[stop] - sums[first]) * down[first]
    segment = mix(whole + mix((anchor - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)))
    doc = np.searchsorted(ends, first, "right")
    return hashes[anchor], segment, doc, first - starts[doc], anchor - first << 8 | count


@dataclass(frozen=True)
class Plan:
    """What an operator searches: how texts become items, window width, and when a window counts as repeated."""

    width: int
    gram: int
    #: Items of a text as one byte string, ``size`` bytes each, and the hashed items of such a string.
    encode: Callable[[str], bytes]
    hashed: Callable[[bytes], np.ndarray]
    size: int
    #: Bytes of text for an anchor, roughly.
    spread: int
    #: Whether another place in the same document counts (every place is then repeated), or only a smaller document.
    anywhere: bool
    #: Repeated windows of a group: (segments, windows of each, least documents, counts) -> a bit mask for each segment.
    compare: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray] = field(repr=False)
    hot: int = HOT


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as one compressed string, byte planes apart."""
    rows = np.stack([c.view(np.uint64) for c in columns])
    return zstandard.compress(rows.view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1).tobytes(), 1)


def _unpack(packed: pa.Scalar, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed.as_buffer()), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(columns, -1)


def _anchored(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of chunks of text: gram hash, segment hash, row, document, and place: items before the gram (8 bits), windows (8), first window (32)."""
    most = 1 << 23
    for part in slices(batches, "text", CHUNK_BYTES):
        rows, ids = part.column("row").to_numpy(), part.column("doc").to_numpy()
        own, items, ends, total = [], [], [], 0

        def close() -> tuple[np.ndarray, ...]:
            h, s, d, first, count = anchors(np.concatenate(items), np.array(ends), plan.width, plan.gram)
            at = np.array(own, np.int64)[d]
            return h, s, rows[at], ids[at], count << 32 | first

        for i, text in enumerate(part.column("text").to_pylist()):
            x = plan.hashed(plan.encode(text))
            # a document of 2^23 items or more is cut into pieces that overlap by all but one item of a window
            for at in range(0, len(x) - plan.width + 1, most):
                piece = x[at : at + most + plan.width - 1]
                if len(piece) < len(x):
                    h, s, _, first, count = anchors(piece, np.array([len(piece)]), plan.width, plan.gram)
                    yield h, s, np.full(len(h), rows[i]), np.full(len(h), ids[i]), count << 32 | first + at
                    continue
                if total and total + len(piece) >= most:
                    yield close()
                    own, items, ends, total = [], [], [], 0
                own.append(i)
                items.append(piece)
                total += len(piece)
                ends.append(total)
        if own:
            yield close()


def _chunks(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same, by gram, in chunks of ``CHUNK`` anchors or a little more."""
    held, n = [], 0

    def close() -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    for own in _anchored(plan, batches):
        held.append(own)
        n += len(own[0])
        if n >= CHUNK:
            yield close()
            held, n = [], 0
    if n:
        yield close()


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted hashes, and where each begins and the last one ends."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
    return bucket[cuts[:-1]], cuts


def _runs(h: np.ndarray) -> np.ndarray:
    """Where each value of sorted ``h`` begins."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])


def _grams(plan: Plan, buckets: int):
    """Grams of chunks with their counts, or their least and greatest documents, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, _, doc, _ in _chunks(plan, batches):
            at = _runs(h)
            if plan.anywhere:
                own = (h[at], np.diff(np.append(at, len(h))))
            else:
                own = (h[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at))
            bucket, cuts = _by_bucket(own[0], buckets)
            packed = [_pack(*(c[a:b] for c in own)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    return run


def _repeated(plan: Plan):
    """The grams of each bucket that may repeat, sorted."""

    def close(held: list[np.ndarray]) -> bytes:
        own = np.concatenate(held, axis=1)
        own = own[:, np.argsort(own[0], kind="stable")]
        at = _runs(own[0])
        if plan.anywhere:
            keep = np.add.reduceat(own[1], at) > 1
        else:
            keep = np.minimum.reduceat(own[1].view(np.int64), at) < np.maximum.reduceat(own[2].view(np.int64), at)
        return own[0][at][keep].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if b != bucket and held:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([close(held)], pa.binary())], names=["bucket", "packed"])
                    held = []
                bucket = b
                held.append(_unpack(packed, 2 if plan.anywhere else 3))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([close(held)], pa.binary())], names=["bucket", "packed"])

    return run


def _places(plan: Plan, buckets: int, unique: bool):
    """All anchors, packed by bucket; without the document where it is the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chunks(plan, batches):
            bucket, cuts = _by_bucket(own[0], buckets)
            salt = np.full(len(bucket), int(own[2][0] ^ own[4][0]) % SALTS, np.int32)
            sent = own[:3] + own[4:] if unique else own
            packed = [_pack(*(c[a:b] for c in sent)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(salt), pa.array(packed, pa.binary())], names=["bucket", "salt", "packed"])

    return run


def _known(columns: list[str]):
    """The anchors whose gram may repeat: the grams of a bucket and a salt come first, then its anchors, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, grams, held, n = None, np.zeros(0, np.uint64), [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in np.concatenate(held, axis=1)], names=columns)

        for batch in batches:
            keys = zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist())
            for key, anchor, packed in zip(keys, batch.column("anchor").to_pylist(), batch.column("packed")):
                if not anchor:
                    of, grams = key, np.frombuffer(packed.as_buffer(), np.uint64).copy()
                    continue
                if key != of or not len(grams):
                    continue
                own = _unpack(packed, len(columns))
                at = np.minimum(np.searchsorted(grams, own[0]), len(grams) - 1)
                own = own[:, grams[at] == own[0]]
                if own.shape[1]:
                    held.append(own)
                    n += own.shape[1]
                if n >= OUT_ROWS:
                    yield close()
                    held, n = [], 0
        if held:
            yield close()

    return run


def _fetch(plan: Plan):
    """The segments of the wanted places, each in up to two parts: windows with more before the gram, and the others."""
    size, width, gram = plan.size, plan.width, plan.gram
    half = (width - gram + 1) // 2
    names = ("g", "h", "s", "base", "windows", "doc", "n", "segment")
    kinds = {"base": pa.int32(), "windows": pa.int32(), "segment": pa.binary()}
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            out: list[list] = [[] for _ in names]
            for text, want in zip(part.column("text").to_pylist(), part.column("want")):
                data = plan.encode(text)
                fields = want.values
                for h, s, doc, loc, n in zip(*(fields.field(k).to_pylist() for k in ("h", "s", "doc", "loc", "n"))):
                    first, count, before = loc & LOW32, loc >> 32 & 255, loc >> 40
                    at = first + before
                    left = min(max(before - (width - gram - half), 0), count)
                    for side, base, stop in ((0, 0, left), (1, left, count)):
                        if base < stop:
                            key = data[(at - half) * size : (at + gram) * size] if side == 0 else data[at * size : (at + gram + half) * size]
                            row = (digest(key, side) - (1 << 63), h, s, base, stop - base, doc, n, data[(first + base) * size : (first + stop + width - 1) * size])
                            for column, v in zip(out, row):
                                column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in zip(names, out)], names=list(names))

    return run


def _single(plan: Plan):
    """The windows of segments one by one, each with the hash of all its items."""
    size, width = plan.size, plan.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows").to_numpy()
            at = np.repeat(np.arange(batch.num_rows), windows)
            offset = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
            segments = batch.column("segment").to_pylist()
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(segments[i][o * size : (o + width) * size]) for i, o in zip(at.tolist(), offset.tolist())), np.int64).reshape(-1, 2)
            own = {c: batch.column(c).to_numpy()[at] for c in ("h", "s", "base", "doc", "n")}
            own["base"] = (own["base"] + offset).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *map(pa.array, own.values())], names=["k1", "k2", *own])

    return run


def _compare(plan: Plan):
    """Masks of repeated windows, group by group; whole groups up to ``GROUP_BYTES`` go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        holds = 0

        def close(parts: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(parts)
            col = lambda c: rows.column(c).to_numpy()
            masks = plan.compare(rows.column("segment").to_pylist(), col("windows").astype(np.int64), col("doc"), col("n")) << col("base").astype(np.int64)
            found = np.flatnonzero(masks)
            return pa.RecordBatch.from_arrays([pa.array(col("h")[found]), pa.array(col("s")[found]), pa.array(masks[found])], names=["h", "s", "mask"])

        for batch in batches:
            keys = batch.column("g").to_numpy()
            if not len(keys):
                continue
            sizes = pc.binary_length(batch.column("segment")).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.diff(keys) != 0) + 1, len(keys)]
            if held and held[-1].column("g")[-1].as_py() != keys[0] and holds >= GROUP_BYTES:
                yield close(held)
                held, holds = [], 0
            start = 0
            before = np.concatenate(([0], np.cumsum(sizes)))
            for c in cuts:
                if holds + before[c] - before[start] >= GROUP_BYTES and c < len(keys):
                    held.append(batch.slice(start, c - start))
                    yield close(held)
                    held, holds, start = [], 0, c
            if start < len(keys):
                held.append(batch.slice(start))
                holds += before[-1] - before[start]
        if held:
            yield close(held)

    return run


def _full(loc: Column) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftright({loc}, 32) & 255 as int)) - 1")


@dataclass(frozen=True)
class Texts:
    """(row, doc, doc_id, text): ``row`` is unique; ``unique``: it is the document's id itself."""

    df: DataFrame
    unique: bool

    @staticmethod
    def of(docs: DataFrame) -> Texts:
        own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        unique = not own.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if unique:
            return Texts(own.withColumn("row", F.col("doc")), True)
        return Texts(Table(own.withColumn("row", F.monotonically_increasing_id()), "texts", compression="zstd").df, False)


def find(texts: Texts, plan: Plan) -> Table:
    """(row, hits) of the rows with repeated windows; hits: array<struct<start, mask>>: window start + i where bit i is set."""
    unique, texts = texts.unique, texts.df
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(FEWEST * parts, size // plan.spread // BUCKET)
    own = texts.select("row", "doc", "text")
    dealt = own.mapInArrow(_grams(plan, buckets), "bucket int, packed binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    grams = Table(dealt.mapInArrow(_repeated(plan), "bucket int, packed binary"), "grams")
    every = own.mapInArrow(_places(plan, buckets, unique), "bucket int, salt int, packed binary").select("bucket", "salt", F.lit(True).alias("anchor"), "packed")
    first = grams.df.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(False).alias("anchor"), "packed")
    met = first.union(every).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "anchor")
    columns = ["h", "s", "row", "loc"] if unique else ["h", "s", "row", "doc", "loc"]
    known = Table(met.mapInArrow(_known(columns), ", ".join(f"{c} long" for c in columns)), "places", compression="zstd")
    grams.drop()
    places = known.df.withColumn("doc", F.col("row" if unique else "doc"))

    by = places.groupBy("h", "s")
    ends = (F.max("doc").alias("high"), F.count("*").alias("n"))
    if unique:
        # numbers only, which are aggregated by hashing; any place in the least document will do
        equal = by.agg(F.min("row").alias("row"), F.min_by("loc", "row").alias("loc"), *ends).withColumn("doc", F.col("row"))
    else:
        equal = by.agg(F.min(F.struct("doc", "row", "loc")).alias("first"), *ends).select("h", "s", "first.*", "high", "n")
    again = F.col("n") > 1 if plan.anywhere else F.col("doc") < F.col("high")
    segments = Table(equal.withColumn("again", again).drop("high"), "segments", compression="zstd")
    groups = segments.df.groupBy("h").agg(F.count("*").alias("segments")).where("segments > 1")
    # written, so that both sides of the joins below come straight from a shuffle and a hot key's rows are split
    shared = Table(groups.select(F.col("h").alias("gram")), "shared")
    wanted = segments.df.join(shared.df, F.col("h") == F.col("gram")).groupBy("row").agg(F.collect_list(F.struct("h", "s", "doc", "loc", "n")).alias("want"))
    schema = "g long, h long, s long, base int, windows int, doc long, n long, segment binary"
    fetched = Table(own.join(wanted.hint("shuffle_hash"), "row").select("text", "want").mapInArrow(_fetch(plan), schema), "fetched", compression="zstd")
    prefixes = Table(fetched.df.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select(F.col("g").alias("prefix"), (F.col("c") > plan.hot).alias("large")), "prefixes")
    met = Table(fetched.df.join(prefixes.df, F.col("g") == F.col("prefix")).drop("prefix"), "met", compression="zstd")
    fetched.drop()
    groups = met.df.where("not large").repartition(parts, "g").sortWithinPartitions("g", "h", "s")
    masks = groups.mapInArrow(_compare(plan), "h long, s long, mask long")
    # groups of one full prefix each: a node as deep as a window, its leaves counted before they meet
    single = met.df.where("large").drop("g", "large").mapInArrow(_single(plan), "k1 long, k2 long, h long, s long, base int, doc long, n long")
    nodes = Table(single.groupBy("k1", "k2").agg(F.min("doc").alias("low"), F.sum("n").alias("total")), "nodes")
    repeated = F.col("total") > 1 if plan.anywhere else F.col("low") < F.col("doc")
    deep = single.join(nodes.df, ["k1", "k2"]).where(repeated).select("h", "s", F.expr("shiftleft(1L, base)").alias("mask"))
    found = Table(masks.union(deep).groupBy("h", "s").agg(F.bit_or("mask").alias("mask")), "masks")
    for table in (shared, prefixes, met, nodes):
        table.drop()

    telling = segments.df.join(found.df, ["h", "s"], "left").select("h", "s", F.col("doc").alias("low"), "again", F.coalesce("mask", F.lit(0)).alias("mask")).where("mask <> 0 or again")
    told = Table(telling, "telling")
    everywhere = F.col("again") if plan.anywhere else F.col("doc") > F.col("low")
    hits = places.join(told.df, ["h", "s"]).select("row", "loc", F.when(everywhere, _full("loc")).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    out = Table(hits.groupBy("row").agg(F.collect_list(F.struct(F.expr(f"loc & {LOW32}").alias("start"), "mask")).alias("hits")), "hits")
    for table in (known, segments, found, told):
        table.drop()
    return out


def covered(starts: np.ndarray, masks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` items a repeated window covers."""
    bits = np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, o = np.nonzero(bits)
    at = starts[row] + o
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:n]) > 0


def apply(docs: DataFrame, plan: Plan, finish: Callable[[str, np.ndarray | None], list], schema: str) -> DataFrame:
    """(doc_id, ...): ``finish(text, flags of covered items or None)`` for every row of ``docs``."""
    texts = Texts.of(docs)
    hits = find(texts, plan)
    kinds = dict(docs.dtypes)
    joined = texts.df.join(hits.df.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "hits")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    arrow = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            out = []
            for t, found in zip(part.column("text").to_pylist(), part.column("hits")):
                flags = None
                if found.is_valid:
                    v = found.values
                    n = len(plan.encode(t)) // plan.size
                    flags = covered(v.field("start").to_numpy(), v.field("mask").to_numpy(), plan.width, n)
                out.append(finish(t, flags))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(arrow))], names=["doc_id", *names])

    return joined.mapInArrow(run, f"doc_id {kinds['doc_id']}, {schema}")
