"""Substring dedup of word sequences by prefix-partitioned suffix trees.

``_repeats`` brings suffixes that may repeat together and splits them into groups that fit in memory, by a common gram and half
of the rest of a window, and, where that leads to too many, by prefixes of 35 words. Over each group stands one suffix tree, cut
at the depth of a window: suffixes are ranked by prefixes of 1, 2, 4, ... words, common prefixes of neighbours follow from the
ranks, and a stack turns them into internal nodes. The suffixes below a node as deep as a window, and leaves of several equal
suffixes, are what repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import _repeats

WIDTH = 35
GRAM = 8


def encode(text: str) -> bytes:
    """64-bit hashes of the words of ``text``: runs of anything but ASCII white space."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in text.encode().split()], np.uint64).tobytes()


def prefix_ranks(items: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of each suffix by its first ``length`` items) for lengths 1, 2, 4, ... and ``width``."""
    rank = np.unique(items, return_inverse=True)[1].astype(np.int64)
    out, length = [(1, rank)], 1
    while length < width:
        step = min(length, width - length)
        ahead = np.append(rank[step:], np.full(step, -1))[: len(rank)]
        rank = np.unique(rank * (int(rank.max()) + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        length += step
        out.append((length, rank))
    return out


def common_prefixes(ranks: list[tuple[int, np.ndarray]], order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each suffix with the one before, ``width`` at most, by descending prefix lengths."""
    a, b = order[1:], order[:-1]
    n = len(ranks[0][1])
    lcp = np.where(ranks[-1][1][a] == ranks[-1][1][b], width, 0)
    open_ = np.flatnonzero(lcp < width)
    for length, rank in reversed(ranks[:-1]):
        x, y = a[open_] + lcp[open_], b[open_] + lcp[open_]
        fits = (x < n) & (y < n)
        same = fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        lcp[open_] += np.where(same, length, 0)
    return np.append(0, np.minimum(lcp, width))


def deep_nodes(lcp: np.ndarray, depth: int) -> list[tuple[int, int, int, int]]:
    """The internal nodes of the tree at string depth ``depth`` or more: (depth, start, stop, parent), parents after children.

    ``lcp`` are common prefixes of neighbouring leaves; a node spans the leaves [start, stop). ``parent`` is the number of the
    node above in the list, -1 where that is not as deep as ``depth``. Leaves of no node differ from all others before it.
    """
    nodes: list[list[int]] = []
    held = np.flatnonzero(lcp >= depth)
    runs = np.split(held, np.flatnonzero(np.diff(held) > 1) + 1) if len(held) else []
    for run in runs:
        # nodes under construction: depth, first leaf, finished children
        open_: list[tuple[int, int, list[int]]] = []
        for k, d in zip(run.tolist(), lcp[run].tolist()):
            start, below = k - 1, []
            while open_ and open_[-1][0] > d:
                deep, start, kids = open_.pop()
                for kid in [*kids, *below]:
                    nodes[kid][3] = len(nodes)
                nodes.append([deep, start, k, -1])
                below = [len(nodes) - 1]
            if open_ and open_[-1][0] == d:
                open_[-1][2].extend(below)
            else:
                open_.append((d, start, below))
        stop, below = int(run[-1]) + 1, []
        while open_:
            deep, start, kids = open_.pop()
            for kid in [*kids, *below]:
                nodes[kid][3] = len(nodes)
            nodes.append([deep, start, stop, -1])
            below = [len(nodes) - 1]
    return [tuple(n) for n in nodes]


def compare(segments: list[bytes], windows: np.ndarray, doc: np.ndarray, n: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each segment, its windows that occur twice or more, ``n`` occurrences of each segment counted, as a bit mask."""
    sizes = np.array([len(s) // 8 for s in segments])
    first = np.cumsum(sizes) - sizes
    items = np.frombuffer(b"".join(segments), np.uint64)
    of = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[of] + offset
    ranks = prefix_ranks(items, width)
    leaves = np.argsort(ranks[-1][1][starts], kind="stable")
    hit = n[of] > 1  # a leaf of several equal suffixes
    for _, start, stop, parent in deep_nodes(common_prefixes(ranks, starts[leaves], width), width):
        if parent < 0:
            hit[leaves[start:stop]] = True
    masks = np.zeros(len(segments), np.int64)
    np.bitwise_or.at(masks, of[hit], np.int64(1) << offset[hit])
    return masks


def _finish(text: str, flags: np.ndarray | None) -> list:
    words = text.encode().split()
    kept = words if flags is None else [w for w, f in zip(words, flags.tolist()) if not f]
    return [len(words), len(words) - len(kept), b" ".join(kept).decode()]


PLAN = _repeats.Plan(width=WIDTH, gram=GRAM, encode=encode, hashed=lambda b: np.frombuffer(b, np.uint64), size=8, spread=84, anywhere=True, compare=compare)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words no repeated window covers, joined by one space.

    Null and empty texts have no words; a repeated row repeats all its windows; null ids are ids like any other; other
    columns are ignored; an empty table gives an empty one.
    """
    return _repeats.apply(docs.select("doc_id", "text"), PLAN, _finish, "n_words long, n_removed long, text string")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`drop_repeats`."""

    def digest(text: str, flags: np.ndarray | None) -> list:
        n, gone, kept = _finish(text, flags)
        return [n, gone, hashlib.sha256(kept.encode()).hexdigest()]

    return _repeats.apply(docs.select("doc_id", "text"), PLAN, digest, "n_words long, n_removed long, kept_sha256 string")
