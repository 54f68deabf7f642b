import hashlib
import random

import corpus_pipeline
from gridloom.llm import decontaminate, quality_rules

from .test_bpe import PATH  # noqa: F401
from .test_line_dedup import brute as brute_lines
from .test_quality_rules import brute as brute_quality
from .test_simhash import brute as brute_simhash


def corpus(seed=21):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "rt", "sh")]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows, items = [], [(k, prose(25)) for k in range(4)]
    for i in range(160):
        text = "Shared License Line.\n" * (i % 9 == 0) + prose(r.randrange(30, 90))
        if i % 17 == 3:
            text += "\n" + items[i % 4][1]
        if i % 13 == 5:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text))
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 3)] + [(300, None), (301, ""), (302, "Shared License Line.\n" * 30)]
    return rows, items, [(i, 0 if i % 13 == 5 else 1) for i in range(120)]


def test_stages_match_brute_force(spark, tmp_path):
    rows, items, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    one = {r.doc_id: r.text for r in kept.collect()}
    assert not any(brute_quality(t)[5] for t in one.values())
    clean = {i for i, t in rows if not brute_quality(t)[5] and "***" not in t}
    assert set(one) == clean

    two = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, kept, str(tmp_path)).collect()}
    assert {(i, hashlib.sha256(r.text.encode()).hexdigest()) for i, r in two.items()} == {(i, sha) for i, _, _, sha in brute_lines(list(one.items()), 10)}
    assert all(r.n_chars == len(r.text) for r in two.values())

    groups = brute_simhash([(i, r.text) for i, r in two.items()])
    three = {i for i, _, c in groups if i == c}
    leaked = {i for i in three if any(x in " ".join(two[i].text.split()) for _, x in items)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == three - leaked and leaked
    assert all(r.decoded_sha256 == hashlib.sha256(two[r.doc_id].text.encode()).hexdigest() and r.n_tokens > 0 for r in got)


def test_stage_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert decontaminate.WINDOW == 5 and quality_rules.MIN_WORDS == 20


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_nulls_and_clashing_columns(spark, tmp_path):
    rows, items, labels = corpus(seed=4)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    own = [(i, t) for i, t in rows if t and "***" not in t and not brute_quality(t)[5]][:20]
    own = own + own[:5] + [(None, own[3][1]), (None, own[6][1] + " and a tail"), (None, None), (own[0][0], ""), (7777, "word " * 30_000 + own[1][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2, 3) for i, t in own], "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, n_lines int, root int")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(corpus_pipeline.STAGES)
    for name, want in (("quality rules", None), ("line dedup", len(own)), ("benchmark decontamination", None)):
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == names
        assert want is None or got.count() == want
    kept = stages["simhash near-dedup"](spark, docs, str(tmp_path))
    texts = [r.text or "" for r in kept.collect()]
    assert kept.columns == names and len(set(texts)) == len(texts) and set(texts) <= {t or "" for _, t in own}
    assert stages["byte-level BPE"](spark, docs, str(tmp_path)).count() == len(own)
