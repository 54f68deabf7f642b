import random
from itertools import combinations

import corpus_pipeline
from gridloom.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    comp = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    near = [(i, j) for i, j in combinations(sorted(comp), 2) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return comp, near


def texts(seed=8):
    r = random.Random(seed)
    vocab = [f"wort{k}" for k in range(500)]
    out = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([4, 60, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice([0, 1, len(base) // 60, len(base) // 45, len(base) // 25])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out + [None, "", " \n", "one", "ONE", "five words are one shingle"])]


def test_groups_match_brute_force(spark):
    rows = texts()
    want, near = brute(rows)
    assert len(near) > 60
    got = {r.row: r.root for r in near_copies.groups(spark.createDataFrame(rows, "row long, text string")).collect()}
    assert got == want


def test_stage_drops_copies_that_fingerprints_miss(spark):
    rows = texts(9)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want, _ = brute(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == set(want.values())
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), "").count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (9, "A b c d E"), (None, "f g"), (None, "F g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text.lower()) for r in near_copies.keep_one(docs).collect()) == [(0, "f g"), (5, "a b c d e")]
