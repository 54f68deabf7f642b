"""Line dedup: frequent lines in a sharded minimal perfect hash that documents probe.

Two passes over the texts and no shuffle of lines or texts. The first counts, for each distinct line key, the documents that
hold it: counts are combined in each batch, then by Spark. Keys that reach the threshold are dealt over shards; each shard
becomes a minimal perfect hash (bucket displacements) with an array of 64-bit fingerprints and one of counts, written to the
shared folder. The second pass probes the arrays: a task loads the shards that its keys fall in, one at a time, and keeps a
few. A shard holds about ``SHARD_KEYS`` keys, so memory does not grow with the corpus; a hot line is one key of one shard.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Table, release, slices

MIN_DOCS = 10
MIN_CHARS = 1
SHARD_KEYS = 200_000
SHARDS_HELD = 8
CHUNK_BYTES = 4 << 20
#: Keys of a displacement bucket, on average.
LOAD = 4
LOW = np.uint64(0xFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: str | None) -> list[bytes]:
    """A key for each line: ASCII white space stripped at both ends, A-Z lower-cased; null and empty texts are one empty line."""
    return [line.strip() for line in (text or "").encode().lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode()) >= least)


def _pair(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _slots(b: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
    x = (b ^ (np.asarray(d).astype(np.uint64) * STEP)) * STEP
    x ^= x >> np.uint64(29)
    return (((x * STEP) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _bucket(a: np.ndarray, n: int) -> np.ndarray:
    return (((a >> np.uint64(32)) * np.uint64(n // LOAD + 1)) >> np.uint64(32)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements, fingerprints and counts of a minimal perfect hash over distinct keys (a, b).

    A bucket of several keys gets the first displacement that sends all of them to free slots; a bucket of one key, a free
    slot itself (coded as -1 - slot).
    """
    n = len(a)
    bucket = _bucket(a, n)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n // LOAD + 1)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    displace = np.zeros(len(sizes), np.int32)
    free, slot_of = np.ones(n, bool), np.zeros(n, np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] < 2:
            break
        own = order[starts[k] : starts[k] + sizes[k]]
        first = 0
        while True:
            tried = np.arange(first, first + 32)
            at = _slots(b[own][None, :], tried[:, None], n).astype(np.int64)
            fits = free[at].all(axis=1)
            if sizes[k] > 1:
                fits &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if fits.any():
                i = int(fits.argmax())
                displace[k], slot_of[own] = tried[i], at[i]
                free[at[i]] = False
                break
            first += 32
            if first > 1 << 24:
                raise RuntimeError("two line keys share all their hash bits")
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    displace[single], slot_of[order[starts[single]]] = -1 - left, left
    prints, held = np.empty(n, np.uint64), np.empty(n, np.int64)
    prints[slot_of], held[slot_of] = b, counts
    return displace, prints, held


def probe(shard: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The count of each key, 0 where the fingerprint at its slot is another."""
    displace, prints, held = shard
    n = len(prints)
    d = displace[_bucket(a, n)]
    at = np.where(d < 0, -1 - d.astype(np.int64), _slots(b, np.maximum(d, 0), n).astype(np.int64))
    return np.where(prints[at] == b, held[at], 0)


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches, "text", CHUNK_BYTES):
            seen: Counter = Counter()
            for text in part.column("text").to_pylist():
                seen.update({digest(k) for k in line_keys(text) if _long_enough(k, least)})
            if seen:
                a, b = _pair(list(seen))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, held = None, []

    def close() -> pa.RecordBatch:
        a, b, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        parts = build(a.view(np.uint64), b.view(np.uint64), n)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["shard", "displace", "prints", "counts"])

    for batch in batches:
        ids = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and ids[i] != shard:
                yield close()
                held = []
            shard = int(ids[i])
            held.append([batch.column(c).to_numpy()[i:j] for c in ("a", "b", "n")])
    if held:
        yield close()


class Index:
    """Where each shard lies, and the few shards that a worker holds."""

    def __init__(self, files: dict[int, str], shards: int, min_docs: int, min_chars: int):
        self.files, self.shards, self.min_docs, self.min_chars = files, shards, min_docs, min_chars
        self.held: OrderedDict = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"held": OrderedDict()}

    def load(self, shard: int):
        if shard in self.held:
            self.held.move_to_end(shard)
        else:
            fs, path = pyarrow.fs.FileSystem.from_uri(self.files[shard])
            rows = pq.read_table(path, filesystem=fs, filters=[("shard", "=", shard)]).to_pylist()[0]
            self.held[shard] = (np.frombuffer(rows["displace"], np.int32), np.frombuffer(rows["prints"], np.uint64), np.frombuffer(rows["counts"], np.int64))
            if len(self.held) > SHARDS_HELD:
                self.held.popitem(last=False)
        return self.held[shard]

    def frequent(self, keys: list[bytes]) -> set[bytes]:
        """Those of the distinct keys that reach the threshold."""
        if not keys or not self.files:
            return set()
        a, b = _pair([xxhash.xxh3_128_digest(k) for k in keys])
        shard = (a % np.uint64(self.shards)).astype(np.int64)
        found: set = set()
        for s in np.unique(shard).tolist():
            if s in self.files:
                own = np.flatnonzero(shard == s)
                found.update(keys[i] for i in own[probe(self.load(s), a[own], b[own]) >= self.min_docs].tolist())
        return found


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> Index:
    """Count the documents of each line key of column ``text`` and write the shards of those in ``min_docs`` or more."""
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_count(min_chars), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    frequent = Table(counted.where(F.col("n") >= min_docs), "lines")
    shards = frequent.df.count() // shard_keys + 1
    unsigned = F.expr(f"cast(pmod(cast(a as decimal(20,0)) + case when a < 0 then 18446744073709551616 else 0 end, {shards}) as int)")
    dealt = frequent.df.withColumn("shard", unsigned).repartition(shards, "shard").sortWithinPartitions("shard")
    index = Table(dealt.mapInArrow(_index, "shard int, displace binary, prints binary, counts binary"), "line-index")
    rows = index.df.select("shard", F.col("_metadata.file_path").alias("path")).collect()
    frequent.drop()
    return Index({r.shard: _readable(r.path) for r in rows}, shards, min_docs, min_chars)


def _readable(path: str) -> str:
    """A file's address as pyarrow writes it: Hadoop has other names for some stores."""
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path))


def drop_frequent(texts: list, index: Index) -> tuple[list[int], list[int], list[str]]:
    """Lines before, lines dropped and the text left, for each text."""
    keys = [line_keys(t) for t in texts]
    gone = index.frequent([k for k in dict.fromkeys(k for own in keys for k in own) if _long_enough(k, index.min_chars)])
    dropped, kept = [], []
    for text, own in zip(texts, keys):
        flags = [k in gone for k in own]
        dropped.append(sum(flags))
        kept.append("\n".join(line for line, f in zip((text or "").split("\n"), flags) if not f) if dropped[-1] else text or "")
    return [len(k) for k in keys], dropped, kept


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with ``text`` less its frequent lines, and ``n_lines``, ``n_dropped`` (replacing columns of those names).

    Lines are split at \\n. A key of ``min_chars`` or more code points that ``min_docs`` or more documents hold loses all its
    lines everywhere. A null or empty text is one empty line and stays empty; a text that loses all lines becomes empty.
    Every row is a document of its own, repeated rows too. An empty table gives an empty one.
    """
    index = build_index(docs, min_docs, min_chars, shard_keys)
    plain = docs.drop("n_lines", "n_dropped")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            lines, dropped, kept = drop_frequent(part.column("text").to_pylist(), index)
            own = [pa.array(kept, pa.string()) if c == "text" else part.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])
        release()

    schema = ", ".join(f"`{c}` {kind}" for c, kind in plain.dtypes) + ", n_lines long, n_dropped long"
    return plain.mapInArrow(run, schema)


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`dedup_lines`."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents
), lines AS (
  SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM docs
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY row, doc_id
"""
