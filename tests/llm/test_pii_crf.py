import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import pii_crf

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


PIECES = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1.9.8", "1.2.3.4.5.6.7.8", "a@b.co", "é.x+y@mail-1.example.com.", "a@b@c.d", "@x.y", "a@.b", "+1 (555) 010-9999", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "007", "A1B2", "ünd", "\n", "ok", "-", "."]


def test_base_matches_brute_force():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(PIECES) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(14)))
        assert [(pii_crf.KINDS[k], a, b) for k, a, b in pii_crf.base_spans(text)] == brute(text), text


def test_query_and_consistency(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        n = f"{r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        rows.append((i, f"Call +1 ({n} now, id 42 and a{i}@b.example.com, again +1 ({n} ok" if i % 2 else f"order {i} of 17 items"))
    rows += [(300, None), (301, ""), (302, "w " * 60_000 + "x@y.z"), (302, "w"), (None, "1.2.3.4")]
    rows.append((303, "Call +1 (312) 555-7788 please. Later: 1-312-555-7788 and 999 things, p@q.example.com P@Q.EXAMPLE.COM"))
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, spans string")
    got = pii_crf.op2(docs).collect()
    assert len(got) == len(rows)
    texts = {(i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or "")).encode()).hexdigest()): t for i, t in rows}
    for x in got:
        text = texts[x.doc_id, x.base_sha256] or ""
        base = brute(text)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(b[0] == k for b in base) for k in pii_crf.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(x.spans.split(",")) | {""}
    one = next(x for x in got if x.doc_id == 303)
    text = rows[-1][1]
    assert f"phone:{text.index('1-312')}:{text.index('1-312') + 14}" in one.spans.split(",")
    assert pii_crf.op2(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def weights():
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    return pii_crf.fit(*pii_crf.Graph.of([(t, pii_crf.base_spans(t)) for t in texts]).cases())


def added(text, weights):
    g = pii_crf.Graph.of([(text, pii_crf.base_spans(text))])
    marginals, settled = pii_crf.infer(g, weights)
    assert settled.all()
    return [(pii_crf.KINDS[k], text[a:b]) for k, a, b in pii_crf.added_spans(g, marginals, [text])[0]]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 400])
@pytest.mark.parametrize("kind, match, other", [("phone", "+1 (312) 555-7788", "1-312-555-7788"), ("card", "4111 1111 1111 1111", "4111.1111.1111.1111"), ("ip", "192.168.100.17", "192-168-100-17")])
def test_all_repeats_of_a_match_get_its_kind(weights, n, kind, match, other):
    assert added(f"see {match} now. " + f"then {other}, say, " * n, weights) == [(kind, other)] * n
    assert added(f"then {other}, say", weights) == []


def test_hidden_matches_are_told_by_their_repeats(weights):
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    caught = wrong = 0
    for _ in range(200):
        a, b, c = digits(3), digits(3), digits(4)
        text = f"x +1 ({a}) {b}-{c} y {digits(16)} z 1-{a}-{b}-{c}, {digits(10)} order {digits(5)}"
        found = added(text, weights)
        caught += ("phone", f"1-{a}-{b}-{c}") in found
        wrong += len(found) - (("phone", f"1-{a}-{b}-{c}") in found)
    assert caught >= 190 and wrong <= 2


def test_marginals_on_trees_are_exact():
    r = np.random.default_rng(4)
    size = len(pii_crf.KINDS) + 1
    for _ in range(20):
        n = 5
        w = pii_crf.Potentials(r.normal(size=(pii_crf.FEATURES, size)), *((m + m.T) / 2 for m in r.normal(size=(2, size, size))))
        parent = [(int(r.integers(0, k)), k) for k in range(1, n)]
        words = ["12", "a@b", "1.2.3.4", "+1", "x9"]
        base = [0, 0, 2, 0, 0]
        g = pii_crf.Graph([0] * n, [(0, 1)] * n, words, base, [None] * n, parent[::2], parent[1::2])
        unary = np.array([pii_crf._shape(x) for x in words], float) @ w.shape
        want = np.zeros((n, size))
        for y in itertools.product(range(size), repeat=n):
            if any(b and v != b for b, v in zip(base, y)):
                continue
            score = sum(unary[i, v] for i, v in enumerate(y)) + sum(w.chain[y[i], y[j]] for i, j in g.chain) + sum(w.skip[y[i], y[j]] for i, j in g.skip)
            for i, v in enumerate(y):
                want[i, v] += np.exp(score)
        got, settled = pii_crf.infer(g, w)
        assert settled.all()
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_long_digit_runs():
    began = time.perf_counter()
    assert [x for x in pii_crf.base_spans("0" * 5000 + ".1.1.1") if x[0] == 1] == [(1, 0, 5006)]
    pii_crf.base_spans("1" * 500_000 + " " + "1." * 100_000)
    assert time.perf_counter() - began < 5
