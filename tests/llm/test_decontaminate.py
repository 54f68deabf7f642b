import random

import corpus_pipeline
from gridloom.llm import decontaminate as d

ITEM = "Maria buys 12 apples for 3 dollars each and then Maria gives 12 of them to her brother Paul before lunch on the way home"
ALIKE = "so she read: Maria buys 40 apples for 9 dollars each and then Maria gives 40 of them to her brother Otto before lunch on the way home. ok"
BROKEN = "so she read: Maria buys 40 apples for 9 dollars each and then Maria gives 41 of them to her brother Otto before lunch on the way home. ok"


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string, doc_id string")


def test_catches_verbatim_and_reparameterised(spark):
    rows = [(1, "Intro text here. " + ITEM + " and more", 0), (2, ALIKE, 0), (3, BROKEN, 0), (4, "the way home was long and the brother of them had lunch", 0), (5, None, 0), (6, "", 0), (None, ITEM, 0), (1, "Intro text here. " + ITEM + " and more", 0), (7, ITEM.split("and then")[0] * 9000, 0)]
    docs, items = tables(spark, rows, [(9, ITEM, "x"), (10, "too short", "x"), (None, ITEM, "x"), (11, None, "x")])
    got = {(r.doc_id, r.item_id): r for r in d.op5(docs, items).collect()}
    assert set(got) == {(1, 9), (2, 9), (3, 9), (None, 9)}
    assert got[1, 9].verbatim and got[1, 9].n_matched == got[1, 9].n_windows
    assert not got[2, 9].verbatim and got[2, 9].n_slots > 2
    shuffled = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items, most=0).collect()}
    assert shuffled == set(got)
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "7"]


def test_slots_go_by_place_and_names_by_name(spark):
    item = "we know that 12 apples cost 12 dollars and that Anna met Otto when Anna came to see Otto because Anna liked Otto very much"
    numbers = item.replace("12 apples", "40 apples").replace("12 dollars", "9 dollars")
    inserted = item.replace("cost", "always cost").replace("12", "77").replace("Anna", "Berta")
    mixed = "we know that Anna met Karl when Emil came to see Lena because Rolf liked Sven very much"
    docs, bench = tables(spark, [(1, numbers, 0), (2, inserted, 0), (3, mixed, 0)], [(1, item, "x"), (2, "we know that Anna met Otto when Anna came to see Otto because Anna liked Otto very much", "x")])
    got = {(r.doc_id, r.item_id): r for r in d.op5(docs, bench).collect()}
    assert {(1, 1), (2, 1)} <= set(got) and not {k for k in got if k[0] == 3}


def test_recall_on_reparameterised_items(spark):
    r = random.Random(4)
    nouns = "apples boats coins doors eggs forks gloves hats".split()
    verbs = "buys sells paints counts carries".split()
    people = "Anna Berta Clara Dora Emil Fritz Greta Hans Ida Jon".split()

    def item(values):
        n, p, noun, verb, place = values
        return f"on a sunny day {p[0]} {verb} {n[0]} {noun} for {n[1]} dollars at the {place} and later {p[0]} meets {p[1]} who has {n[2]} more {noun} so how many {noun} do they hold after {n[3]} hours"

    def values():
        return [r.randrange(2, 99) for _ in range(4)], r.sample(people, 2)

    fixed = [(r.choice(nouns), r.choice(verbs), r.choice("market harbour school bakery".split())) for _ in range(40)]
    bench = [(k, item((*values(), *f)), "x") for k, f in enumerate(fixed)]
    rows = [(k, "some words before. " + item((*values(), *f)) + " and some after", 0) for k, f in enumerate(fixed)]
    rows += [(1000 + k, f"on a cloudy night {people[k % 10]} reads {k} books about the harbour and later sleeps for {k} hours", 0) for k in range(40)]
    docs, items = tables(spark, rows, bench)
    got = {(x.doc_id, x.item_id) for x in d.op5(docs, items).collect()}
    assert sum((k, k) in got for k in range(40)) == 40 and not {x for x in got if x[0] >= 1000}


def test_tokens_of_whole_texts_are_those_of_words(spark):
    r = random.Random(8)
    pieces = ["12", "km", "Km.", "(kg)", "Anna", "Otto,", "\"Ida\"", "the", "end.", "ok?", "A1", "x9.", "3.5", "...", "!", "Éva", "ǅ", "don't", "a...b", "(5", "h", "S", "UNITS", "<num>", "[x]", "--", "5-kg", "Kilo"]
    rows = [(k, " ".join(r.choice(pieces) for _ in range(r.randrange(0, 25))) if k % 3 else r.choice(["\n", "\t ", "  "]).join(r.choice(pieces) for _ in range(12))) for k in range(600)] + [(600, None), (601, ""), (602, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for exact in (False, True):
        slow = sorted((x.doc_id, x.hash) for x in d.windows(docs, "doc_id", exact=exact).collect())
        assert sorted((x.doc_id, x.hash) for x in d.hashes(docs, "doc_id", exact=exact).collect()) == slow and len(slow) > 3000


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, ITEM, 0)], [(9, ITEM, "x")])
    assert d.op5(docs.limit(0), items).count() == d.op5(docs, items.limit(0)).count() == 0


def test_dense_and_short_items(spark):
    numbers = "Sort these: 4 9 2 7 1 8 3 12 15 6"
    people = "the list: Anna Berta Clara Dora Emma Frieda Gerda Hanna Ida Jana"
    items = [(1, numbers, "x"), (2, people, "x"), (3, "Define osmosis briefly", "x"), (4, "yes", "x"), (5, "Name the Capital of France now", "x"), (6, "red cars like Anna and Berta", "x")]
    rows = [
        (1, "well then. " + numbers + " is what it said", 0),
        (2, "so here is " + people + " and so on", 0),
        (3, "please define OSMOSIS, briefly. ok", 0),
        (4, "yes", 0),
        (5, "yes it was the list of all these", 0),
        (6, "he said Name the Capital of France now or never", 0),
        (7, "see the list: Karl Ludwig Moritz Norbert Otto Paul Quirin Rolf Sven Theo and so on", 0),
        (8, "few red cars like Otto and that is all", 0),
    ]
    docs, bench = tables(spark, rows, items)
    want = {(1, 1), (2, 2), (3, 3), (4, 4), (6, 5)}
    for most in (d.BROADCAST, 0):
        got = d.contaminated(docs, bench, most=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.item_id: r.n_windows for r in got} == {1: 8, 2: 8, 3: 1, 4: 1, 5: 2}


def test_changed_values_of_a_partly_dense_item(spark):
    item = "she wrote down the whole list of numbers again: 4 9 2 7 1 8 3 12 15 6 11 13 17 19 21 23 25"
    changed = "she wrote down the whole list of numbers again: " + " ".join(str(k) for k in range(40, 57))
    docs, bench = tables(spark, [(1, changed, 0)], [(1, item, "x")])
    assert [r.verbatim for r in d.op5(docs, bench).collect()] == [False]


def test_stage_drops_rows_whatever_their_id(spark, tmp_path):
    _, bench = tables(spark, [(1, ITEM, 0)], [(9, ITEM, "x")])
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, ITEM), (5, "see " + ITEM), (5, "other text"), (None, "clean text"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.text) for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()) == ["None", "clean text", "other text"]
