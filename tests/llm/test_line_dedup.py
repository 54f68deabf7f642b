import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from gridloom.llm import line_dedup


def brute(rows, least):
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\r\x0b\x0c"))
    docs = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            docs[strip(line)].add(n)
    gone = {k for k, v in docs.items() if k and len(v) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if strip(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    r = random.Random(1)
    common = [f"Líne {k} " for k in range(30)]
    rows = []
    for i in range(300):
        lines = [r.choice([r.choice(common), f"own {i} {r.random()}", "", "  \t", "\x0bLÍNE 3\r"]) for _ in range(r.randrange(12))]
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (7, "líne 1\n" * 9000), (7, "líne 1"), (None, "Líne 2"), (None, None)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_lines int").repartition(5)
    assert sorted(map(tuple, line_dedup.op6(docs).collect()), key=str) == brute(rows, 10)
    small = line_dedup.dedup_lines(docs, shard_keys=4)
    got = [(x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.text.encode()).hexdigest()) for x in small.collect()]
    assert sorted(got, key=str) == brute(rows, 10)


def test_empty_table(spark):
    assert line_dedup.op6(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hash_is_minimal_and_perfect():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 5000):
        a, b = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), r.integers(0, 1 << 63, n, dtype=np.uint64)
        shard = line_dedup.build(a, b, np.arange(1, n + 1))
        assert (line_dedup.probe(shard, a, b) == np.arange(1, n + 1)).all()
        assert (line_dedup.probe(shard, a, b + np.uint64(1 << 63)) == 0).all()
