import corpus_pipeline
from gridloom.llm import near_copies, simhash

from .test_near_copies import brute, texts


def test_fingerprints_alone_name_candidates(spark, monkeypatch):
    rows = texts()
    data = spark.createDataFrame(rows, "row long, text string")
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(data, id_col="row").collect()}
    near = [(i, j) for i, j in brute(rows)[1] if component[i] == component[j] == i]
    alone = near_copies.by_minima
    monkeypatch.setattr(near_copies, "by_minima", lambda sets: alone(sets).limit(0))
    root = {r.row: r.root for r in near_copies.groups(data).collect()}
    assert len(near) > 20 and all(root[i] == root[j] for i, j in near)
    # verified: nothing but copies by similarity
    assert all(brute(rows)[0][i] == brute(rows)[0][r] for i, r in root.items())


def test_stage_asks_the_fingerprints(spark, monkeypatch):
    asked, own = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, **more: asked.append(docs.count()) or own(docs, **more))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts(9)], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.drop_copies(spark, docs, "").count()
    assert asked == [docs.count()]
