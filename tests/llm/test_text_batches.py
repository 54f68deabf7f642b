import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gridloom.llm import near_copies, simhash

from .test_near_copies import texts


class Plan:
    """Stands for a DataFrame: gives back what it was to run in workers."""

    dtypes = [("doc_id", "bigint")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])


@pytest.mark.parametrize("words", [600, 250_000])
def test_fingerprints_hold_few_shingles(spark, words):
    r = random.Random(words)
    word = [f"w{k}" for k in range(5000)]
    rows = [" ".join(r.choices(word, k=words)) for _ in range(500_000 // words)] + [None, "", "one"]
    run, data = simhash.fingerprints(Plan()), [batch(rows)]
    tracemalloc.start()
    try:
        got = [x for b in run(iter(data)) for x in b.column("fp").to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50e6
    assert np.array(got).view(np.uint64).tolist() == [int(simhash.long_fingerprint(t or "", 4)) for t in rows]


def test_variants_hold_a_pass_of_a_block():
    fps = np.random.default_rng(2).integers(0, 1 << 63, simhash.BLOCK + 300, dtype=np.int64)
    data, masks = [pa.RecordBatch.from_arrays([pa.array(fps)], names=["fp"])], simhash._masks(2)
    found, most = [], 0
    for turn in range(8):
        tracemalloc.start()
        out = list(simhash._emit(2, 8, turn, 5)(iter(data)))
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        for b in out:
            for v, m in zip(b.column("variants").to_pylist(), b.column("masks").to_pylist()):
                found.append(np.frombuffer(v, np.uint64) ^ masks[np.frombuffer(m, np.uint16)])
    # each fingerprint comes back from each of its variants
    assert most < 60e6
    assert (np.sort(np.concatenate(found)) == np.repeat(np.sort(fps.view(np.uint64)), len(masks))).all()


def test_texts_travel_in_small_batches(spark, monkeypatch):
    seen = {}

    def spy(module):
        own = module.write

        def write(df, name):
            seen[name] = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
            return own(df, name)

        monkeypatch.setattr(module, "write", write)

    spy(simhash)
    spy(near_copies)
    spy(corpus_pipeline)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts()[:20]], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_copies(spark, docs, "")
    assert corpus_pipeline.tokenize(spark, left, "").count() == left.count()
    assert all(int(seen[name]) <= 256 for name in ("described", "fingerprints", "alike", "crowded", "tokens"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
