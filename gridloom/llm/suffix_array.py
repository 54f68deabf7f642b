"""Suffix-array dedup of byte strings by two-stage sorting.

``_repeats`` brings the distinct segments that may share a string together in bounded groups. Over each group stands one
suffix array, sorted in two stages: suffixes that are smaller than their successors are sorted directly; all others follow
from a scan of the buckets in order, each suffix putting its predecessor at the front of the predecessor's bucket. Common
prefixes of neighbours then tell which strings repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import _repeats

WIDTH = 50
GRAM = 16
#: Hashes of the byte values: a fixed pseudo-random table from a rule.
TABLE = _repeats.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_repeats.BASE))


def words_at(text: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """The eight symbols from ``at + shift`` on as one number, in sorting order; ``text`` ends in padding."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + (shift + k)]
    return out


def sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by their first ``depth`` symbols (rounded up to eight): ties of one step are what the next one sorts."""
    key = words_at(text, at, 0)
    order = np.argsort(key, kind="stable")
    key, order = key[order], at[order]
    fresh = np.append(True, key[1:] != key[:-1])[: len(at)]
    for shift in range(8, depth, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        own = np.flatnonzero(tied)
        if not len(own):
            break
        group, key = np.cumsum(fresh)[own], words_at(text, order[own], shift)
        step = np.lexsort((key, group))
        order[own], key = order[own][step], key[step]
        fresh[own[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` suffixes of ``text`` (then ``depth`` + 16 zeros) in the order of at least their first ``depth`` symbols."""
    n = len(text) - depth - 16
    step = np.sign(text[1 : n + 1].astype(np.int16) - text[:n].astype(np.int16))
    # equal neighbours have the sort of the next unequal ones
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.append(step, [1])[following] > 0
    # what the scan passes through: the wanted suffixes and, from each that does not rise, on to the next one that does
    inside = np.zeros(n + 1, bool)
    inside[wanted] = True
    front = wanted[~rising[wanted]] + 1
    while len(front):
        front = front[(front < n)]
        front = front[~inside[front]]
        inside[front] = True
        front = np.unique(front[~rising[front]]) + 1
    held = np.flatnonzero(inside)
    direct = sort_directly(text, held[rising[held]], depth)
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    falls = inside[:n] & ~rising
    if n and not rising[n - 1] and inside[n - 1]:
        arrived[text[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        own = arrived[c]
        k = 0
        while k < len(own):
            before = own[k][own[k] > 0] - 1
            same = before[falls[before] & (text[before] == c)]
            if len(same):
                own.append(same)
            k += 1
        bucket = np.concatenate([*own, direct[bounds[c] : bounds[c + 1]]]) if own or bounds[c] < bounds[c + 1] else np.zeros(0, np.int64)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[falls[before] & (text[before] > c)]
        if len(before):
            symbols = text[before]
            order = np.argsort(symbols, kind="stable")
            symbols, before = symbols[order], before[order]
            cuts = np.append(np.flatnonzero(np.diff(symbols, prepend=-1)), len(symbols))
            for a, b in zip(cuts, cuts[1:]):
                arrived[symbols[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before, ``depth`` at most, in whole steps of eight until they differ."""
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for shift in range(0, depth, 8):
        a, b = words_at(text, order[live], shift), words_at(text, order[live - 1], shift)
        differ = a ^ b
        if depth - shift < 8:
            differ >>= np.uint64(8 * (8 - depth + shift))
        same = differ == 0
        lcp[live] = np.where(same, min(depth, shift + 8), shift)
        live = live[same]
    return lcp


def compare(segments: list[bytes], windows: np.ndarray, doc: np.ndarray, n: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each segment, its windows that also start in a segment of a smaller document, as a bit mask."""
    sizes = np.array([len(s) for s in segments])
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(segments) + bytes(width + 16), np.uint8)
    of = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[of] + offset
    owner = np.full(len(text), -1, np.int32)
    owner[starts] = np.arange(len(of))
    order = suffix_array(text, starts, width)
    order = order[owner[order] >= 0]
    runs = np.flatnonzero(common_prefixes(text, order, width) < width)
    window = owner[order]
    low = np.minimum.reduceat(doc[of[window]], runs) if len(runs) else np.zeros(0, np.int64)
    low = np.repeat(low, np.diff(np.append(runs, len(order))))
    hit = window[low < doc[of[window]]]
    masks = np.zeros(len(segments), np.int64)
    np.bitwise_or.at(masks, of[hit], np.int64(1) << offset[hit])
    return masks


PLAN = _repeats.Plan(
    width=WIDTH, gram=GRAM, encode=str.encode, hashed=lambda b: TABLE[np.frombuffer(b, np.uint8)], size=1, spread=16, anywhere=False, compare=compare
)


def _finish(text: str, flags: np.ndarray | None) -> list:
    data = text.encode()
    if flags is None:
        return [len(data), 0, 0, hashlib.sha256(data).hexdigest()]
    kept = np.frombuffer(data, np.uint8)[~flags].tobytes()
    spans = int((np.diff(flags.astype(np.int8), prepend=0) == 1).sum())
    return [len(data), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()]


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns. Null and empty texts have no bytes; a null id counts as larger than all others and rows with
    equal ids do not remove each other's bytes; other columns are ignored; an empty table gives an empty one."""
    return _repeats.apply(docs.select("doc_id", "text"), PLAN, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): the maximal byte runs that :func:`op9` removes."""
    from pyspark.sql import functions as F

    def runs(text: str, flags: np.ndarray | None) -> list:
        if flags is None:
            return [""]
        edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        return [",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2))]

    parts = F.split("item", ":")
    found = _repeats.apply(docs.select("doc_id", "text"), PLAN, runs, "runs string").where("runs <> ''")
    return found.select("doc_id", F.explode(F.split("runs", ",")).alias("item")).select("doc_id", parts[0].cast("int").alias("start"), parts[1].cast("int").alias("stop"))
