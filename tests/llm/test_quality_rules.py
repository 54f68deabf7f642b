import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import quality_rules as q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def texts():
    r = random.Random(4)
    vocab = ["ab", "Çé", "x#", "<y>", "zz", "q w", "$", "😀"]
    out = [None, "", " \n\t", "a b c d e f g h", "a " * 15, "a " * 16, "w " * 30_000, "\n x y\x0b z \r\n x y\x0b z \n"]
    for _ in range(150):
        n = r.choice([5, 25, 60, 300])
        out.append("".join(r.choice(vocab[: r.choice([1, 3, 8])]) + r.choice([" ", "  ", "\n", "\t "]) for _ in range(n)))
    out += ["one two three four five six seven eight nine ten " * 3 + " ".join(f"u{k}" for k in range(40))]
    return out


def test_statistics_match_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r[0]: tuple(r[1:7]) for r in q.op3(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_list_is_learned_and_filters(spark):
    r = random.Random(9)
    plain = lambda: " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(80))
    rows = [(i, plain() if i % 4 else " ".join(w + "***" for w in plain().split()), "clash") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 300)] + [(None, 0), (5, None)], "doc_id long, quality int")
    kept = q.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i in range(400) if i % 4}
    assert q.op3(docs.limit(0), labels).count() == 0


def test_rules_are_ordered_conjunctions():
    g = np.random.default_rng(0)
    x = {f: g.random(900) for f in q.RATES}
    bad = (x["symbol_rate"] > 0.8) & (x["upper_rate"] <= 0.5) | (x["mean_word"] > 0.9)
    rules = q.learn_list(x, bad)
    caught = np.logical_or.reduce([rule.covers(x) for rule in rules])
    assert (caught & bad).sum() > 0.8 * bad.sum() and (caught & ~bad).sum() < 0.05 * bad.sum()
    assert isinstance(q.verdict(rules), type(F.lit(1)))
