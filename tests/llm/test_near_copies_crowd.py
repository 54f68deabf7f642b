import random

import pytest

from gridloom.llm import near_copies

from ..test_copies import most_rows
from .test_near_copies import brute, texts


@pytest.mark.parametrize("members", [3, 512])
def test_blocks_match_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(near_copies, "PAIRED", 1)
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    rows = texts(11)
    got = {r.row: r.root for r in near_copies.groups(spark.createDataFrame(rows, "row long, text string")).collect()}
    assert got == brute(rows)[0]


def test_a_crowd_is_not_spelled_out_as_pairs(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in r.sample(range(10, 90), 3):
            own[at] = f"x{i}at{at}"
        rows.append((i, " ".join(own)))
    data = spark.createDataFrame(rows, "row long, text string")
    got, most = most_rows(spark, lambda: {x.row: x.root for x in near_copies.groups(data).collect()}, "Join")
    want, near = brute(rows)
    assert got == want and len(set(want.values())) > 20
    assert most < 30_000
