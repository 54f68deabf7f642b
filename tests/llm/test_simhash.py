import random
import re

import xxhash

from gridloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def brute(rows):
    prints = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in comp:
            for j in comp:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return {(i, f"{prints[i]:016x}", comp[i]) for i in prints}


def texts(seed=3):
    r = random.Random(seed)
    vocab = [f"Wörd{k}" for k in range(300)]
    out = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 40, 400]))]
        for _ in range(r.choice([1, 3, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" \t".join(copy))
    return [(i, t) for i, t in enumerate(out + [None, "", "  \n", "one", "Zero x y", "word " * 5000])]


def test_matches_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    got = simhash.op7(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (9, "A b c d E")], "doc_id long, text string")
    assert [r.component_id for r in simhash.op7(docs).collect()] == [5, 5, 5, 5]
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [5]
    assert [r.doc_id for r in simhash.keep_one(docs.where("doc_id is null")).collect()] == [None]
    assert simhash.op7(docs.limit(0)).count() == 0


def test_chain_of_links_is_one_component(spark):
    chain = [(1 << (2 * k)) - 1 for k in range(20)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in chain], "fp long"), passes=2)
    roots = {r.root for r in simhash.components(edges).collect()}
    assert roots == {0}


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 100):
        text = " \t".join(r.choice(["Ab", "é", "cd", "x"]) + str(r.randrange(9)) for _ in range(n))
        own = simhash.shingle_hashes(text, 4)
        assert simhash.long_fingerprint(text, 4) == simhash._majority(own, [len(own)])[0]
