import dataclasses
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import _repeats, suffix_array, suffix_tree

SCHEMA = "doc_id long, text string, hits int, doc string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(rows, width=50):
    order = lambda i: (1 << 63) - 1 if i is None else i
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            low[b[k : k + width]] = min(order(i), low.get(b[k : k + width], order(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if low[b[k : k + width]] < order(i):
                gone[k : k + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def brute_words(rows, width=35):
    seen = Counter()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for w in words:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out, key=str)


def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeiouné") for _ in range(r.randrange(1, 8)))
    vocab = [word() for _ in range(400)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = [prose(r.choice([10, 34, 35, 36, 40, 120])) for _ in range(12)]
    out = []
    for i in range(140):
        w = prose(r.randrange(0, 120))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            w[k:k] = r.choice(shared)
        out.append(r.choice([" ", " ", "\n"]).join(w))
    out += out[:6] + [out[7] + " tail", None, "", " ", "x" * 400, "x" * 130, "ab " * 200, "ab " * 100, "\x00" * 60 + "a", "\x00" * 70]
    rows = list(enumerate(out))
    r.shuffle(rows)
    return [*rows, (3, out[3]), (500, out[9]), (None, out[10]), (None, out[11])]


@pytest.mark.parametrize("hot", [_repeats.HOT, 1])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_array, "PLAN", dataclasses.replace(suffix_array.PLAN, hot=hot))
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, suffix_array.op9(docs).collect()), key=str) == brute_bytes(rows)


@pytest.mark.parametrize("hot", [_repeats.HOT, 1])
def test_words_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree, "PLAN", dataclasses.replace(suffix_tree.PLAN, hot=hot))
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, suffix_tree.op8(docs).collect()), key=str) == brute_words(rows)


def test_empty_tables_and_spans(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.op9(none).count() == suffix_tree.op8(none).count() == 0
    docs = spark.createDataFrame([(1, "q" + "abcdefghij" * 6), (2, "z" + "abcdefghij" * 6 + "y")], "doc_id long, text string")
    assert [tuple(x) for x in suffix_array.spans(docs).collect()] == [(2, 1, 61)]
    assert {x.text for x in suffix_tree.drop_repeats(docs).collect()} == {x.text for x in docs.collect()}


def test_two_stage_order_is_suffix_order():
    r = np.random.default_rng(1)
    for size in (1, 2, 4, 256):
        text = r.integers(0, size, 700).astype(np.uint8)
        padded = np.append(text, np.zeros(66, np.uint8))
        wanted = np.sort(r.choice(650, 300, replace=False))
        order = suffix_array.suffix_array(padded, wanted, 50)
        order = order[np.isin(order, wanted)]
        keys = [bytes(padded[i : i + 50]) for i in order]
        assert sorted(order) == wanted.tolist() and keys == sorted(keys)
        lcp = suffix_array.common_prefixes(padded, order, 50)
        assert [x == 50 for x in lcp[1:]] == [a == b for a, b in zip(keys, keys[1:])]


def test_tree_depths():
    r = np.random.default_rng(2)
    items = r.integers(0, 2, 300).astype(np.uint64)
    ranks = suffix_tree.prefix_ranks(items, 35)
    starts = np.arange(300 - 35)
    order = starts[np.argsort(ranks[-1][1][starts], kind="stable")]
    lcp = suffix_tree.common_prefixes(ranks, order, 35)
    for k in range(1, len(order)):
        a, b = items[order[k - 1] :][:35], items[order[k] :][:35]
        same = np.flatnonzero(a != b)
        assert lcp[k] == (same[0] if len(same) else 35)


def test_equal_windows_pick_equal_anchors():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 4, n).astype(np.uint64) for n in (200, 80, 49, 50, 0, 120)]
    docs[1][10:75] = docs[0][100:165]
    ends = np.cumsum([len(d) for d in docs])
    h, s, d, first, count = _repeats.anchors(_repeats.mix(np.concatenate(docs)), ends, 50, 20)
    window = defaultdict(set)
    for k in range(len(h)):
        for o in range(count[k] & 255):
            window[docs[d[k]][first[k] + o : first[k] + o + 50].tobytes()].add(h[k])
    assert sum(count & 255) == sum(max(0, len(x) - 49) for x in docs)
    assert all(len(v) == 1 for v in window.values())


def test_rows_are_told_apart_whatever_their_ids(spark):
    r = random.Random(5)
    prose = lambda: "".join(r.choice("abcdefghij klm") for _ in range(400))
    same = prose()
    rows = [(None, "x" * 60), (None, "y"), (1, "x" * 60), *((i, prose()) for i in (7, 7, 7, None, None)), *((9, same) for _ in range(30)), *((None, same) for _ in range(30)), (12, "pre" + same)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, suffix_array.op9(docs).collect()), key=str) == brute_bytes(rows)
    assert sorted(map(tuple, suffix_tree.op8(docs).collect()), key=str) == brute_words(rows)


def test_very_long_texts(spark, monkeypatch):
    r = random.Random(6)
    long = " ".join(r.choice(["ab", "cde", "f", "ghij", "k"]) + str(r.randrange(50)) for _ in range(40_000))
    rows = [(2, long), (1, long[5000:9000]), (3, "q" + long[100_000:100_300] + "z")]
    monkeypatch.setattr(_repeats, "CHUNK_BYTES", 1000)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, suffix_array.op9(docs).collect()), key=str) == brute_bytes(rows)
    assert sorted(map(tuple, suffix_tree.op8(docs).collect()), key=str) == brute_words(rows)


def test_nodes_of_the_tree():
    r = random.Random(7)
    for _ in range(200):
        n = r.randrange(2, 30)
        lcp = np.array([0, *(r.randrange(0, 7) for _ in range(n - 1))])
        want = set()
        for a in range(n):
            for b in range(a + 2, n + 1):
                low = min(lcp[a + 1 : b])
                if low >= 3 and lcp[a] < low and (b == n or lcp[b] < low):
                    want.add((low, a, b))
        nodes = suffix_tree.deep_nodes(lcp, 3)
        assert {x[:3] for x in nodes} == want and len(nodes) == len(want)
        for d, a, b, parent in nodes:
            above = [x for x in want if x[1] <= a and x[2] >= b and x[0] < d]
            assert (parent < 0 and not above) or nodes[parent][:3] == max(above)
