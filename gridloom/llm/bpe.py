"""Byte-level BPE by DuckDB queries in each partition.

A worker keeps one DuckDB database with the vocabulary and all mergeable pairs. The pieces of a batch that it has not seen
become rows (word, position, token); a recursive query joins neighbours to the merge table and contracts each word's leftmost
pair of least rank until no word has one. Documents are then strung together from their pieces, and an ordered aggregate over
(document, position, token) rows decodes them; a text that does not come back byte for byte is an error.

A word of n bytes leaves at most n (n + 1) / 2 rows in the recursion, so a query takes words up to ``ROWS`` of them, and a decode
takes ``BLOCK`` tokens, cutting documents where it must: memory does not depend on how long words or texts are. As the time
grows with that square, too, pieces over ``LONG`` bytes follow the same rule with a heap. The memory of pieces seen is emptied at
``SEEN`` entries; batches are cut by bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cached_property

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import release, slices

LONG = 256
SEEN = 250_000
#: Words of a query, and rows that their recursion may leave.
WORDS, ROWS = 25_000, 4_000_000
CHUNK_BYTES = 4 << 20
#: Tokens that one query decodes.
BLOCK = 1 << 18
#: A candidate is its rank and its position, counted through all words of a query, in one number.
SHIFT, MASK = 32, (1 << 32) - 1

ENCODE = f"""
WITH RECURSIVE state(word, pos, id, live) AS (
  SELECT word, pos, id, true FROM pieces
  UNION ALL
  SELECT word, pos, CASE WHEN pos = best & {MASK} THEN (best >> {SHIFT})::INTEGER ELSE id END, best IS NOT NULL
  FROM (
    WITH pairs AS (
      SELECT s.word, s.pos, s.id, s.previous, (m.id::BIGINT << {SHIFT}) | s.pos AS candidate
      FROM (SELECT word, pos, id, lead(id) OVER o AS following, lead(word) OVER o AS beside, lag(pos) OVER o AS previous FROM state WHERE live WINDOW o AS (ORDER BY pos)) s
      LEFT JOIN merges m ON m.pair = CASE WHEN s.word = s.beside THEN s.id::BIGINT * 65536 + s.following END
    )
    SELECT pairs.word, pos, id, previous, best FROM pairs LEFT JOIN (SELECT word, min(candidate) AS best FROM pairs GROUP BY word) b ON b.word = pairs.word
  )
  WHERE best IS NULL OR previous IS NULL OR previous <> best & {MASK}
)
SELECT word, id FROM state WHERE NOT live ORDER BY pos
"""
DECODE = "SELECT doc, array_to_string(list(bytes ORDER BY pos), '') AS text FROM coded JOIN vocabulary USING (id) GROUP BY doc"


def read_ranks(path: str) -> bytes:
    """The rank file, to be sent with the tasks: its size is that of a vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one task; closed with it, as workers outlive their tasks."""

    def __init__(self, file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("token ids must be below 65536")
        pairs = [(self.ranks[b[:k]] << 16 | self.ranks[b[k:]], i) for b, i in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        vocabulary = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "id": pa.array([i for _, i in pairs], pa.int32())})  # noqa: F841
        vocabulary = pa.table({"id": pa.array(vocabulary, pa.int32()), "bytes": [b.decode("latin-1") for b in vocabulary.values()]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary")

    def close(self) -> None:
        self.db.close()
        self.__dict__.clear()
        release()

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The merge table once more, for pieces that the recursion would take too long over."""
        return dict(self.db.sql("SELECT pair, id FROM merges").fetchall())

    def _heap(self, piece: bytes) -> bytes:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pair = lambda i: self.pairs.get(ids[i] << 16 | ids[right[i]]) if right[i] < n else None
        queue = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if ids[i] < 0 or pair(i) != rank:
                continue
            gone = right[i]
            ids[i], ids[gone], right[i] = rank, -1, right[gone]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(queue, (r, k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        todo, data = [], []
        for piece in pieces:
            raw = piece.encode()
            if raw in self.ranks:
                self.seen[piece] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > LONG:
                self.seen[piece] = self._heap(raw)
            else:
                todo.append(piece)
                data.append(raw)
        sizes = np.array([len(x) for x in data], np.int64)
        grown = np.cumsum(sizes * (sizes + 1) // 2)
        k = 0
        while k < len(todo):
            done = grown[k - 1] if k else 0
            stop = min(k + WORDS, max(k + 1, int(np.searchsorted(grown, done + ROWS, "right"))))
            part, n = data[k:stop], sizes[k:stop]
            flat = self.single[np.frombuffer(b"".join(part), np.uint8)]
            pieces_rows = {"word": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": np.arange(len(flat)), "id": flat}
            self.db.register("pieces", pa.table(pieces_rows))
            out = self.db.sql(ENCODE).to_arrow_table()
            ids = out.column("id").to_numpy().astype("<u4")
            cuts = np.searchsorted(out.column("word").to_numpy(), np.arange(len(part) + 1)).tolist()
            raw = ids.tobytes()
            self.seen.update(zip(todo[k:stop], (raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:]))))
            k = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.seen) > SEEN:
            self.seen.clear()
        seen = self.seen
        new = {p for own in split for p in own if p not in seen}
        if new:
            self._learn(list(new))
        return [b"".join(map(seen.__getitem__, own)) for own in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each document; one query holds at most ``BLOCK`` tokens, of one document or of several."""
        texts: list[list[bytes]] = [[] for _ in coded]
        held, of, room = [], [], 4 * BLOCK

        def close() -> None:
            for i, t in zip(of, self._decode(held)):
                texts[i].append(t)

        for i, x in enumerate(coded):
            at = 0
            while at < len(x):
                held.append(x[at : at + room])
                of.append(i)
                at += room
                room -= len(held[-1])
                if not room:
                    close()
                    held, of, room = [], [], 4 * BLOCK
        if held:
            close()
        return [b"".join(t) for t in texts]

    def _decode(self, coded: list[bytes]) -> list[bytes]:
        n = np.array([len(x) // 4 for x in coded], np.int64)
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        self.db.register("coded", pa.table({"doc": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        out = self.db.sql(DECODE).to_arrow_table()
        texts = [b""] * len(coded)
        for d, t in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            texts[d] = t.encode("latin-1")
        return texts


def _coded(docs: DataFrame, path: str, pattern: str, schema: str, finish: Callable[[list[bytes], list[bytes]], list[pa.Array]]) -> DataFrame:
    """One row for each row of ``docs``, its columns less those of ``schema``, then what ``finish`` makes of ids and decoded bytes."""
    file, new = read_ranks(path), [c.split()[0] for c in schema.split(", ")]
    plain = docs.drop(*(c for c in new if c != "text"))
    at, names = plain.columns.index("text"), plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for part in slices(batches, "text", CHUNK_BYTES):
            codec = codec or Codec(file, pattern)
            texts = [t or "" for t in part.column(at).to_pylist()]
            coded = codec.encode(texts)
            decoded = codec.decode(coded)
            if any(a.encode() != b for a, b in zip(texts, decoded)):
                raise ValueError("a text did not come back from its tokens")
            own = [part.column(i) for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays([*own, *finish(coded, decoded)], names=[*(c for c in names if c != "text"), *new])
        if codec:
            codec.close()

    return plain.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in plain.dtypes if c != "text"), schema]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (array of token ids) and ``text`` as decoded from them.

    Texts are coded whole, without special tokens; null counts as empty and has no tokens. Rows, repeated ones too, stay;
    columns named n_tokens or ids are replaced. An empty table gives an empty one.
    """

    def finish(coded: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
        n = [len(c) // 4 for c in coded]
        ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
        return [pa.array(n, pa.int64()), ids, pa.array([d.decode() for d in decoded], pa.string())]

    return _coded(docs, path, pattern, "n_tokens long, ids array<int>, text string", finish)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests of ids and decoded bytes in place of both."""

    def finish(coded: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        return [pa.array([len(c) // 4 for c in coded], pa.int64()), sha(coded), sha(decoded)]

    return _coded(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns over the installed vocabulary."""
    import public_tokenizers

    return digests(docs.select(F.col("doc_id"), F.col("text")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
